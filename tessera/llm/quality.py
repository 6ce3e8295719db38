"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model runs over characters of all scripts: every character of the training
text is a symbol, digits as one, and all others are one symbol more. Counts of
four-symbol runs, their continuation counts and the discounts are grouped and
joined by Spark, sharded by the run. Every trusted document is used: most of them
are counted, the others set the thresholds. Each worker holds the table of the
seen runs, and a text is scored by looking up the run that ends at each
character, and shorter runs only where that one was not seen.

A document is kept if its perplexity is at most the threshold of its language:
a quantile over all trusted documents of that language that the model was not
trained on, with a margin; languages with few of those take the threshold of all
where it is higher. Short
texts are drawn towards the mean of the model by a fixed number of characters.

Defined results: null and empty texts have perplexity of the mean, and are kept;
languages (null is one) without trusted documents take the threshold of all;
without any trusted document everything is kept; further columns stay, but for
those with the names of new ones.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import scan
from tessera.llm.scan import U, extend, utf8
from tessera.runtime import Scratch, likely, ship, table

ORDER = 4
#: Bits of a symbol in a run's code: four fill 64.
BITS = 16
MASK = (1 << BITS) - 1
#: The share of the trusted documents that is trained on, by a hash of doc_id; all others set the thresholds.
TRAIN_SHARE = 0.7
#: So many trusted rows outside training give a language a threshold of its own.
OWN_ROWS = 50
#: The thresholds: this quantile of trusted documents' perplexity, times this margin.
QUANTILE, MARGIN = 0.99, 1.1
#: Characters of average text that are added to each text.
DRAWN = 40

_digits: list[np.ndarray] = []


def _folded() -> np.ndarray:
    """Of each code point: the code point that stands for it; digits stand as 0."""
    if not _digits:
        out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
        out[[i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Nd"]] = ord("0")
        _digits.append(out)
    return _digits[0]


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of the texts, each after a 0 and the last before one; where each text begins."""
    cp = np.frombuffer("\0".join(["", *(t.replace("\0", " ") for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    return _folded()[cp], np.cumsum([1] + [len(t) + 1 for t in texts])


class Alphabet:
    """Symbols: 0 borders, 1 characters that training has not (or beyond those that BITS can tell), from 2 on the commonest."""

    def __init__(self, common: list[int]):
        common = common[: MASK - 1]
        self.size = len(common) + 2
        self.of = np.ones(sys.maxunicode + 1, np.uint16)
        self.of[0] = 0
        self.of[common] = np.arange(2, self.size)

    def runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The code of the run of symbols that ends at each character or end, and where each text begins."""
        cp, base = points(texts)
        s = self.of[cp].astype(U)
        code = s[1:].copy()
        # What lies before a text's beginning counts as a border.
        reach = np.arange(1, len(s)) - np.repeat(base[:-1] - 1, np.diff(base))[: len(s) - 1]
        for k in range(1, ORDER):
            back = np.zeros(len(code), U)
            back[k:] = s[1 : len(s) - k]
            code |= np.where(reach > k, back, U(0)) << U(BITS * k)
        return code, base - 1


def _counts(texts: DataFrame, count, schema: str) -> DataFrame:
    return texts.mapInArrow(count, schema).groupBy("code").agg(F.sum("n").alias("n"))


def alphabet(texts: DataFrame) -> Alphabet:
    """The folded characters of the column text, the commonest first, ties by code point."""

    @scan.tidied
    def count(batches):
        total = np.zeros(sys.maxunicode + 1, np.int64)
        for b in batches:
            for lo, hi, _, _ in scan.blocks(t := utf8(b.column(0))):
                np.add.at(total, *np.unique(points(t[lo:hi].to_pylist())[0], return_counts=True))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["code", "n"])

    top = _counts(texts.select("text"), count, "code int, n long").where("code > 0").orderBy(F.desc("n"), "code").limit(MASK - 1).collect()
    return Alphabet([r.code for r in top])


def kneser_ney(runs: DataFrame, symbols: int, scratch: Scratch) -> list[DataFrame]:
    """For each order from 1 up, (code, p) of the seen runs and (code, g), the weight of the next lower order, of their contexts; kind tells which.

    ``runs`` has code and n of the highest order. Lower orders count in how many
    different ways a run is continued to the left.
    """
    counts = [scratch.write(runs, "runs")]
    for k in range(ORDER - 1, 0, -1):
        counts.insert(0, scratch.write(counts[0].groupBy(F.col("code").bitwiseAND(F.lit((1 << BITS * k) - 1)).alias("code")).agg(F.count("*").alias("n")), "runs"))
    out, lower = [], None
    for k, c in enumerate(counts, 1):
        n1, n2, n3, n4 = (c.agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5))).first()[i] for i in range(4))
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        d = [0.0] + [min(max(i - (i + 1) * y * b / a, 0.0), float(i)) if a and n1 else min(0.5 * i, 1.0) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        cut = F.element_at(F.array(*map(F.lit, d[1:])), F.least("n", F.lit(3)).cast("int"))
        c = c.withColumn("ctx", F.shiftrightunsigned("code", BITS)).withColumn("cut", cut)
        totals = c.groupBy("ctx").agg(F.sum("n").alias("t"), F.sum("cut").alias("g")).select("ctx", "t", (F.col("g") / F.col("t")).alias("g"))
        p = c.join(totals, "ctx").withColumn("low", F.col("code").bitwiseAND(F.lit((1 << BITS * (k - 1)) - 1)))
        if lower is None:
            p = p.withColumn("q", F.lit(1.0 / symbols))
        else:
            p = p.join(lower.select(F.col("code").alias("low"), F.col("p").alias("q")), "low")
        p = p.select("code", ((F.col("n") - F.col("cut")) / F.col("t") + F.col("g") * F.col("q")).alias("p"))
        lower = scratch.write(p, "p")
        out.append(lower.withColumn("kind", F.lit("p")).unionByName(totals.select(F.col("ctx").alias("code"), F.col("g").alias("p"), F.lit("g").alias("kind"))))
    return out


class Table:
    """Values by 64-bit key, in buckets by hash."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = U(64 - max(1, int(np.ceil(np.log2(len(keys) + 1)))))
        h = self._bucket(keys)
        order = np.argsort(h, kind="stable")
        self.keys, self.values = keys[order], values[order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(h, minlength=1 << int(U(64) - self.shift)))]).astype(np.int32)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (scan.mix(keys * U(0x9E3779B97F4A7C15) + U(1)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, whether there is one) for each key."""
        h = self._bucket(keys)
        at, end = self.first[h], self.first[h + 1]
        out, hit = np.zeros(len(keys), np.float32), np.zeros(len(keys), bool)
        live = np.flatnonzero(at < end)
        while len(live):
            now = at[live]
            ok = self.keys[now] == keys[live]
            out[live[ok]] = self.values[now[ok]]
            hit[live[ok]] = True
            live = live[~ok]
            at[live] += 1
            live = live[at[live] < end[live]]
        return out, hit


class Model:
    """What workers get: the alphabet, and by order the seen runs with their log-probabilities and the contexts with the log-weights of what is shorter."""

    def __init__(self, letters: Alphabet, orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]):
        self.letters = letters
        self.tables = [(Table(code, p), Table(ctx, g)) for code, p, ctx, g in orders]

    def log_p(self, code: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log-probability of the last symbol of each run after those before it."""
        out = np.zeros(len(code))
        todo = np.arange(len(code))
        for k in range(order, 0, -1):
            runs, contexts = self.tables[k - 1]
            now = code[todo] & U((1 << BITS * k) - 1)
            p, hit = runs.find(now)
            out[todo[hit]] += p[hit]
            todo, now = todo[~hit], now[~hit]
            out[todo] += contexts.find(now >> U(BITS))[0]  # an unseen context leaves all to what is shorter
        out[todo] -= np.log(self.letters.size)
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each text with its end, and the number of symbols scored."""
        code, base = self.letters.runs(texts)
        return np.add.reduceat(self.log_p(code), base[:-1]), np.diff(base)


def train(texts: DataFrame, scratch: Scratch) -> Model | None:
    """A model of the column text; None if there is none."""
    ship(texts.sparkSession)
    texts = scratch.write(texts.select("text").where("text is not null"), "trusted")
    letters = alphabet(texts)

    @scan.tidied
    def count(batches):
        for b in batches:
            for lo, hi, _, _ in scan.blocks(t := utf8(b.column(0)), 4 << 20):
                u, n = np.unique(letters.runs(t[lo:hi].to_pylist())[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["code", "n"])

    runs = _counts(texts, count, "code long, n long")
    orders, mass = [], 0
    for t in kneser_ney(runs, letters.size, scratch):
        log = F.log(F.greatest("p", F.lit(1e-300))).cast("float")
        got = t.select("code", log.alias("log"), (F.col("kind") == "p").alias("run")).toArrow()  # the seen runs and contexts, 13 bytes each
        code, log, run = (got[c].to_numpy() for c in ("code", "log", "run"))
        mass = int(run.sum())
        orders.append((code[run].view(U), log[run], code[~run].view(U), log[~run]))
    return Model(letters, orders) if mass else None


def perplexities(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("log_prob", "n_symbols")) -> DataFrame:
    """``docs`` with the natural log-probability of each whole text and the symbols it was scored over."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        logs, size = [np.zeros(0)], [np.zeros(0, np.int64)]
        t = utf8(b.column(b.schema.get_field_index(text)))
        for lo, hi, _, _ in scan.blocks(t, 1 << 19):
            x, n = shared.value.score(t[lo:hi].to_pylist())
            logs.append(x)
            size.append(n)
        return [pa.array(np.concatenate(logs)), pa.array(np.concatenate(size).astype(np.int64))]

    return extend(docs, [T.StructField(names[0], T.DoubleType(), False), T.StructField(names[1], T.LongType(), False)], one, keep)


def trusted(labels: DataFrame) -> DataFrame:
    """doc_id of rows labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> tuple[Model | None, DataFrame]:
    """A model of TRAIN_SHARE of the trusted documents, and the doc_ids of all other trusted documents.

    Without any other, the documents trained on stand in for them.
    """
    good = scratch.write(docs.select("doc_id").join(trusted(labels), "doc_id", "left_semi").distinct(), "good")
    trained = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 20)) < TRAIN_SHARE * (1 << 20)
    chosen, others = good.where(trained), good.where(~trained)
    if not chosen.limit(1).count():
        chosen = good
    # Only the trusted texts, and few others, are shuffled.
    model = train(likely(docs.select("doc_id", "text"), chosen).join(chosen, "doc_id", "left_semi"), scratch)
    return model, others if others.limit(1).count() else chosen


def drawn_perplexity(log_prob: str, n: str, mean: float):
    """exp of the mean negative log-probability of a symbol, after DRAWN symbols of average text."""
    return F.exp(-(F.col(log_prob) + F.lit(mean * DRAWN)) / (F.col(n) + F.lit(DRAWN)))


def thresholds(scored: DataFrame, good: DataFrame, mean: float) -> tuple[DataFrame, float | None]:
    """(lang, threshold) and the threshold of all, from the rows of ``scored`` whose doc_id is in ``good``."""
    p = scored.join(good.select("doc_id").distinct(), "doc_id", "left_semi").select("lang", drawn_perplexity("log_prob", "n_symbols", mean).alias("p"))
    at = F.percentile_approx("p", F.lit(QUANTILE), F.lit(100_000)) * MARGIN
    overall = p.agg(at.alias("t")).first().t
    own = p.groupBy("lang").agg(at.alias("threshold"), F.count("*").alias("c"))
    return own.select("lang", F.when(F.col("c") >= OWN_ROWS, F.col("threshold")).otherwise(F.greatest("threshold", F.lit(overall))).alias("threshold")), overall


def judge(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, lang, log_prob, n_symbols, perplexity, threshold, kept) for each row of ``docs``."""
    model, good = fit(docs, labels, scratch)
    if model is None:
        return docs.select("doc_id", "lang", F.lit(0.0).alias("log_prob"), F.lit(0).cast("long").alias("n_symbols"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    scored = scratch.write(perplexities(docs.select("doc_id", "lang", "text"), model, keep=["doc_id", "lang"]), "scored")
    mean = mean_log_prob(scored, good)
    by_lang, overall = thresholds(scored, good, mean)
    by_lang = scratch.write(by_lang, "thresholds").withColumnRenamed("lang", "tlang")
    out = scored.withColumn("perplexity", drawn_perplexity("log_prob", "n_symbols", mean)).join(by_lang, F.col("lang").eqNullSafe(F.col("tlang")), "left")
    out = out.withColumn("threshold", F.coalesce("threshold", F.lit(overall)))
    return out.select("doc_id", "lang", "log_prob", "n_symbols", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)).alias("kept"))


def mean_log_prob(scored: DataFrame, good: DataFrame) -> float:
    """Of a symbol of trusted text."""
    r = scored.join(good.select("doc_id").distinct(), "doc_id", "left_semi").agg(F.sum("log_prob").alias("a"), F.sum("n_symbols").alias("b")).first()
    return r.a / r.b if r.b else 0.0


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document, and whether it is within its language's threshold."""
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op9"))
