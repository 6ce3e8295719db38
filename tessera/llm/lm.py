"""Scores of texts: a word unigram base, and the marginal likelihood of a subword lattice.

Tokens are a text's lower-cased words, then one end. The model is a mixture over
the languages of the training texts. Within a language a word's probability sums
all segmentations into pieces of an existing vocabulary (see ``lattice``), plus
one edge over the whole word, weighted by its count. The pieces' probabilities,
and the share of the whole-word edges, are fitted together by
expectation-maximisation over all training words, each judged by the counts
without itself: so the lattice learns to spell the words that counts do not
foresee. Both start plainly: the pieces at Zipf's law over the vocabulary's
order, the share of the lattice at that of words seen once. The forward
recursion runs once for each distinct word of the corpus, and a text's score is
the log of the sum over languages of the probabilities of its words and end.

No table of words is ever in one place. Texts are packed into blocks; each block
gives its distinct words with counts; these are summed by word over the corpus,
with the blocks that have the word in lists of bounded length; the words are
scored and sent back to their blocks. A word has at most one row for each block
and language, so the commonest word is no hot key, and a text meets the words of
its own block only.

Defined results: null and empty texts have the end only; texts with a null
doc_id are training texts; repeated rows are each scored; null languages are one
language; without training texts nothing is known and every score is the log of
the pieces' start; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import scan
from tessera.llm.lattice import Pieces, by_length
from tessera.llm.scan import utf8
from tessera.runtime import Scratch, ship, table

#: Bytes of text in a block, at least one text.
BLOCK = 16 << 20
#: Languages with components of their own, the commonest in training; any others share one more. Each costs a
#: forward pass over every word and 256 KB of the model that workers get.
COMPONENTS = 63
ROUNDS = 2
#: Blocks in one list of a word's places.
PLACES = 4096
#: Words and bytes that a task of the lattice takes at once: there are then many words of each length.
WORDS, WORDS_BYTES = 1 << 16, 16 << 20
#: Tokens of a block that are counted at once, and rows in a batch of scores.
STEP, ROWS_OUT = 1 << 19, 10_000
SMOOTH = 1e-3
#: Bytes of a block are compressed by this codec while they wait.
CODEC = "zstd"

BLOCK_SCHEMA = "block long, ids array<long>, held array<boolean>, kind array<int>, size array<long>, n_bytes long, body binary"


def pack(docs: DataFrame, langs: list, kinds: int) -> DataFrame:
    """Blocks of whole texts: doc_ids, whether held out, the language's number, sizes, and the compressed bytes."""
    number = {x: i for i, x in enumerate(langs)}
    last = max(kinds - 1, 0)

    @scan.tidied
    def run(batches):
        from pyspark import TaskContext

        part, n, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            body = b"".join(r[3] for r in rows)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part << 32 | n], pa.int64()),
                    pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
                    pa.array([[r[1] for r in rows]], pa.list_(pa.bool_())),
                    pa.array([[r[2] for r in rows]], pa.list_(pa.int32())),
                    pa.array([[len(r[3]) for r in rows]], pa.list_(pa.int64())),
                    pa.array([len(body)], pa.int64()),
                    pa.array([pa.compress(body, CODEC, asbytes=True)], pa.binary()),
                ],
                names=["block", "ids", "held", "kind", "size", "n_bytes", "body"],
            )

        for b in batches:
            for i, h, lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), utf8(b.column(3)).to_pylist(), strict=True):
                raw = t.encode()
                if rows and size + len(raw) > BLOCK:
                    yield close()
                    n, rows, size = n + 1, [], 0
                rows.append((i, h, number.get(lang, last), raw))
                size += len(raw)
        if rows:
            yield close()

    return docs.select("doc_id", "held_out", "lang", "text").mapInArrow(run, BLOCK_SCHEMA)


class Block:
    """A block's texts again, and its tokens."""

    def __init__(self, row: dict):
        self.ids, self.held, self.kind = row["ids"], np.array(row["held"], bool), np.array(row["kind"], np.int64)
        raw = pa.decompress(row["body"], row["n_bytes"], CODEC, asbytes=True) if row["n_bytes"] else b""
        off = np.concatenate([[0], np.cumsum(np.array(row["size"], np.int64))])
        self.buf = np.frombuffer(raw, np.uint8)
        hashes, self.starts, self.ends, counts = [], [], [], []
        lo, n = 0, len(self.ids)
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + scan.BLOCK, side="right")) - 1)
            part = self.buf[off[lo] : off[hi]]
            s, e, at = scan.word_spans(part, off[lo : hi + 1] - off[lo], scan.NOT_SPACE)
            with np.errstate(over="ignore"):
                hashes.append(scan.word_hashes(part, s, e).view(np.int64))
            self.starts.append((s + off[lo]).astype(np.int32))
            self.ends.append((e + off[lo]).astype(np.int32))
            counts.append(np.diff(at))
            lo = hi
        self.hash, hashes = np.concatenate(hashes), None
        self.starts, self.ends = np.concatenate(self.starts), np.concatenate(self.ends)
        self.n_words = np.concatenate(counts)
        self.doc = np.repeat(np.arange(n, dtype=np.int32), self.n_words)

    def numbered(self) -> np.ndarray:
        """Of each token the number of its word, in order of the words' first tokens."""
        return pa.array(self.hash).dictionary_encode().indices.to_numpy()

    def words(self, first: np.ndarray) -> pa.Array:
        """The lower-cased words of these tokens, which are in order."""
        off = np.empty(2 * len(first), np.int64)  # words, and what stands between them
        off[::2], off[1::2] = self.starts[first], self.ends[first]
        low = scan.LOWER[self.buf]
        both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(low)])
        return both.take(pa.array(np.arange(0, len(off) - 1, 2)))


def word_counts(blocks: DataFrame, kinds: int) -> DataFrame:
    """(block, at, word, kind, n): each block's distinct words in order of first appearance, with their training counts by language.

    A word with several languages has several rows, of which the first only has
    ``at``; one only seen outside training has kind -1 and count 0.
    """

    def counted(row):
        k = Block(row)
        if not len(k.hash):
            return
        at, k.hash = k.numbered(), None
        first = np.flatnonzero(np.diff(np.maximum.accumulate(at), prepend=-1))
        words, train = k.words(first), ~k.held
        k.buf = k.starts = k.ends = None
        n = np.zeros(len(first) * kinds, np.int64)
        for i in range(0, len(at), STEP):
            doc = k.doc[i : i + STEP]
            some = train[doc]
            n += np.bincount(at[i : i + STEP][some].astype(np.int64) * kinds + k.kind[doc[some]], minlength=len(n))
        n = n.reshape(-1, kinds)
        k = at = first = None
        none = np.flatnonzero(n.sum(axis=1) == 0)
        w, kind = np.nonzero(n)
        who = np.concatenate([w, none])
        lead = np.ones(len(who), bool)
        lead[1 : len(w)] = w[1:] != w[:-1]
        each = np.concatenate([kind, np.full(len(none), -1)])
        many = np.concatenate([n[w, kind], np.zeros(len(none), np.int64)])
        for i in range(0, len(who), 100_000):
            s = slice(i, i + 100_000)
            part = who[s]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(part), row["block"]), pa.int64()), pa.array(part, pa.int32(), mask=~lead[s]), words.take(pa.array(part)).cast(pa.binary()), pa.array(each[s], pa.int32()), pa.array(many[s], pa.int64())],
                names=["block", "at", "word", "kind", "n"],
            )

    @scan.tidied
    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                yield from counted(row)
                scan.release()

    return blocks.mapInArrow(run, "block long, at int, word binary, kind int, n long")


class Model:
    """Piece probabilities and word weights by language."""

    def __init__(self, pieces: Pieces, n_words: np.ndarray, n_docs: np.ndarray, once: np.ndarray):
        self.pieces = pieces
        kinds = len(n_words)
        self.logp = np.tile(pieces.start, (kinds, 1))
        total = n_words + n_docs
        self.total = np.maximum(total, 1)
        #: The share of whole-word edges; one word more is taken as seen once, so that the lattice always has some.
        self.whole = np.where(total > 0, np.maximum(1 - (once + 1) / self.total, 0.0), 0.0)
        self.n_docs = n_docs
        with np.errstate(divide="ignore"):
            prior = n_docs / max(n_docs.sum(), 1) if n_docs.sum() else np.full(kinds, 1 / kinds)
            self.prior = np.log(prior)
        self.shared = True

    @property
    def end(self) -> np.ndarray:
        """The end is a word that every training text has; where there is none, one of two words."""
        with np.errstate(divide="ignore"):
            return np.log(np.where(self.n_docs > 0, np.maximum(self.whole, 1 / self.total) * self.n_docs / self.total, 0.5))

    def fit(self, uses: np.ndarray, spelled: np.ndarray) -> None:
        """One step: ``uses`` are the expected uses of each piece by language, ``spelled`` the expected words that take the lattice."""
        self.whole = np.where(self.total > 1, 1 - np.clip((spelled + 1) / self.total, 0, 1), 0.0)
        uses = uses + SMOOTH * (uses.sum(axis=0) / max(uses.sum(), 1) * len(self.pieces.pieces) + 1) / 2
        self.logp = np.log(uses / uses.sum(axis=1, keepdims=True))
        self.shared = False

    def words(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """(words, languages) natural log-probabilities; ``counts`` are the words' training counts."""
        lat = np.empty((len(words), len(self.logp)))
        for at, m in by_length(words):
            if m is None:
                lat[at[0]] = [self.pieces.long_word(b" " + words[at[0]], p) for p in self.logp]
                continue
            edges = self.pieces.edges(m)
            for k, p in enumerate(self.logp):
                lat[at, k] = self.pieces.forward(m, p, edges)[:, -1]
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(self.whole * counts / self.total), np.log1p(-self.whole) + lat)

    def spelled(self, k: int, counts: np.ndarray, lat: np.ndarray) -> np.ndarray:
        """Of each word's uses in language k, how many take the lattice, each use judged by the counts without itself."""
        known = self.whole[k] * (counts - 1) / max(self.total[k] - 1, 1)
        spelt = (1 - self.whole[k]) * np.exp(lat)
        return counts * np.divide(spelt, known + spelt, out=np.ones(len(counts)), where=known + spelt > 0)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches."""
    some, rows, size = [], 0, 0
    for b in batches:
        some.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= WORDS or size >= WORDS_BYTES:
            yield pa.concat_batches(some)
            some, rows, size = [], 0, 0
    if some:
        yield pa.concat_batches(some)


def _arrays(b: pa.RecordBatch, kinds: int) -> tuple[list[bytes], np.ndarray]:
    words = b.column(b.schema.get_field_index("word")).to_pylist()
    return words, np.array([b.column(b.schema.get_field_index(f"c{k}")).to_numpy(zero_copy_only=False) for k in range(kinds)], float).T.reshape(len(words), kinds)


def piece_uses(words: DataFrame, model: Model, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """(languages, pieces) expected uses over all training words, and by language the words that take the lattice; a task gives a row for each language and piece."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    @scan.tidied
    def run(batches):
        m = shared.value
        out = np.zeros((kinds, len(m.pieces.pieces) + 1))  # the last: words that take the lattice
        for b in _gathered(batches):
            ws, counts = _arrays(b, kinds)
            for at, mat in by_length(ws, 1 << 14):
                if mat is None:
                    for k in np.flatnonzero(counts[at[0]]).tolist():
                        c = m.spelled(k, counts[at, k], np.array([m.pieces.long_word(b" " + ws[at[0]], m.logp[k])]))
                        m.pieces.long_expected(b" " + ws[at[0]], m.logp[k], c[0], out[k, :-1])
                        out[k, -1] += c[0]
                    continue
                if m.shared:  # one start for all languages, so one lattice for all words
                    edges = m.pieces.edges(mat)
                    forward = m.pieces.forward(mat, m.logp[0], edges)
                    c = np.zeros((len(at), kinds))
                    for k in range(kinds):
                        some = np.flatnonzero(counts[at, k])
                        c[some, k] = m.spelled(k, counts[at[some], k], forward[some, -1])
                    out[:, :-1] += m.pieces.expected(mat, m.logp[0], c, edges, forward)
                    out[:, -1] += c.sum(axis=0)
                    continue
                for k in range(kinds):
                    some = np.flatnonzero(counts[at, k])
                    if not some.size:
                        continue
                    part = mat[some]
                    es = m.pieces.edges(part)
                    f = m.pieces.forward(part, m.logp[k], es)
                    c = m.spelled(k, counts[at[some], k], f[:, -1])
                    out[k, :-1] += m.pieces.expected(part, m.logp[k], c, es, f)
                    out[k, -1] += c.sum()
        k, i = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(i, pa.int32()), pa.array(out[k, i])], names=["kind", "piece", "uses"])

    # At most languages * (pieces + 1) rows.
    got = words.mapInArrow(run, "kind int, piece int, uses double").groupBy("kind", "piece").agg(F.sum("uses").alias("uses")).toPandas()
    out = np.zeros((kinds, len(model.pieces.pieces) + 1))
    out[got.kind.to_numpy(np.int64), got.piece.to_numpy(np.int64)] = got.uses.to_numpy(float)
    return out[:, :-1], out[:, -1]


def score(docs: DataFrame, path: str, scratch: Scratch) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    ``docs`` has doc_id, held_out, lang and text; the model learns from rows that
    are not held out. ``path`` is a merge-type model whose vocabulary is used.
    """
    from tessera.llm import pieces as bpe

    spark = docs.sparkSession
    ship(spark)
    vocabulary = bpe.load(path)
    names = list(vocabulary.score)
    pieces = Pieces(names, [-vocabulary.score[t][0] for t in names])

    per_lang = docs.where("not held_out").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(COMPONENTS + 1).collect()
    langs = [r.lang for r in per_lang[:COMPONENTS]]
    kinds = max(1, len(per_lang))  # beyond COMPONENTS, the last is all other languages
    blocks = scratch.write(pack(docs, langs, kinds), "blocks")
    seen = scratch.write(word_counts(blocks, kinds), "seen")
    # One shuffle, by word: the places of a word, one for each block that has it, stay beside its counts, in lists of bounded length.
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"p{k}") for k in range(kinds)]
    places = F.collect_list(F.when(F.col("at").isNotNull(), F.struct("block", "at"))).alias("places")
    lists = max(1, -(-blocks.count() // PLACES))
    own = Window.partitionBy("word")
    words = seen.withColumn("list", F.pmod(F.xxhash64("block"), F.lit(lists)).cast("int")).repartition("word").groupBy("word", "list").agg(*sums, places)
    # Of a word with several lists, the first counts in statistics.
    words = words.select("word", (F.row_number().over(own.orderBy("list")) == 1).alias("lead"), *(F.sum(f"p{k}").over(own).alias(f"c{k}") for k in range(kinds)), "places")
    words = scratch.write(words, "words")
    scratch.drop(seen)
    total = sum((F.col(f"c{k}") for k in range(kinds)), F.lit(0))
    stats = words.where("lead").agg(*(f(F.col(f"c{k}")).alias(f"{n}{k}") for k in range(kinds) for n, f in (("n", F.sum), ("o", lambda c: F.count_if(c == 1)))), F.count_if(total > 0).alias("v")).first()
    n_words = np.array([stats[f"n{k}"] or 0 for k in range(kinds)], float)
    once = np.array([stats[f"o{k}"] or 0 for k in range(kinds)], float)
    ends = docs.where("not held_out").select(F.coalesce(*(F.when(F.col("lang").eqNullSafe(F.lit(x)), k) for k, x in enumerate(langs)), F.lit(max(kinds - 1, 0))).alias("k")).groupBy("k").count().collect()
    n_docs = np.zeros(kinds)
    for r in ends:
        n_docs[r["k"]] = r["count"]
    all_tokens = int(n_words.sum() + n_docs.sum())
    all_types = int(stats.v) + int(n_docs.sum() > 0)

    model = Model(pieces, n_words, n_docs, once)
    train = words.where("lead").where(total > 0)
    if all_tokens:
        for _ in range(ROUNDS):
            model.fit(*piece_uses(train, model, kinds))
    shared = spark.sparkContext.broadcast(model)

    @scan.tidied
    def run(batches):
        for b in _gathered(batches):
            ws, counts = _arrays(b, kinds)
            lp = shared.value.words(ws, counts)
            done = pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("places")), pa.array(counts.sum(axis=1).astype(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(0, lp.size + 1, lp.shape[1]), pa.int32()), pa.array(lp.astype(np.float32).reshape(-1)))],
                names=["places", "c", "lp"],
            )
            yield from (done.slice(i, ROWS_OUT) for i in range(0, done.num_rows, ROWS_OUT))

    scored = words.mapInArrow(run, "places array<struct<block:long,at:int>>, c long, lp array<float>")
    need = scored.select(F.explode("places").alias("p"), "c", "lp").select("p.block", "p.at", "c", "lp")
    floor = 0.5 * (all_types + 1)
    end_count = float(n_docs.sum())

    def texts(blocks_: pa.Table, words_: pa.Table) -> pa.Table:
        m = shared.value
        order = np.argsort(words_["at"].to_numpy())
        c = words_["c"].to_numpy()[order]
        lp = words_["lp"].combine_chunks().flatten().to_numpy().reshape(-1, len(m.prior))[order].astype(float)
        base = np.log10((c + 0.5) / (all_tokens + floor))
        end = float(np.log10((end_count + 0.5) / (all_tokens + floor)))

        def marginals(row):
            k = Block(row)
            n = len(k.ids)
            at = k.numbered()
            k.buf = k.hash = k.starts = k.ends = None
            known = np.bincount(k.doc, weights=c[at] > 0, minlength=n).astype(np.int64) + int(end_count > 0)
            total_base = np.bincount(k.doc, weights=base[at], minlength=n) + end
            by_kind = np.stack([np.bincount(k.doc, weights=lp[at, j], minlength=n) for j in range(len(m.prior))], axis=1) + m.end + m.prior
            top = by_kind.max(axis=1, keepdims=True)
            marginal = (top[:, 0] + np.log(np.exp(by_kind - top).sum(axis=1))) / np.log(10)
            return pa.table({"doc_id": pa.array(k.ids, pa.int64()), "held_out": pa.array(k.held), "n_tokens": pa.array(k.n_words + 1), "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, all_tokens, np.int64)), "base_score": pa.array(total_base), "score": pa.array(marginal)})

        rows = [marginals(row) for row in blocks_.to_pylist()]
        scan.release()
        return pa.concat_tables(rows) if rows else pa.table({"doc_id": pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), "n_tokens": pa.array([], pa.int64()), "n_known": pa.array([], pa.int64()), "train_tokens": pa.array([], pa.int64()), "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.groupBy("block").cogroup(need.groupBy("block")).applyInArrow(texts, schema)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base and lattice score; learned from the documents whose crc32(doc_id) modulo 5 is not 1."""
    import public_tokenizers

    from tessera.llm.langid import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text", held_out("doc_id", 5).alias("held_out"))
    return score(docs, public_tokenizers.path("piece_bpe_32k.model"), Scratch(spark, "op7"))
