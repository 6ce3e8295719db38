"""SentencePiece encoding and decoding of merge-type (BPE) models, exactly as the library does it.

Encoding finds the one token sequence in which every adjacent pair is
*compatible*: re-merging the pair's own text gives the pair back. Tokens are
tried longest first, from Aho-Corasick matches; where no token fits, the search
steps back, and a bitfield of failed positions keeps it from trying one twice.
Text is cut where no piece can cross (before a space mark, around line ends), so
the search runs over one short segment at a time and recent segments are kept.

Defined results: null and empty texts have the begin and end ids only and decode
to the empty text; rows, ties and repeated texts are independent of each other;
texts are taken whole, however long; further columns are left alone.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import string
import struct
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm import scan
from tessera.llm.scan import extend, utf8
from tessera.runtime import ship

MARK = "▁"
#: Bytes of segments and their ids that a worker keeps in each of two generations, about.
CACHE = 32 << 20
#: Bytes of Python objects for each kept segment, besides its characters and ids; pairs of tokens whose fit is kept.
ENTRY, FITS = 190, 200_000
#: Largest model file that is broadcast.
MODEL_BYTES = 64 << 20


class Model:
    """A merge-type model's pieces, and what the search needs to know of them."""

    def __init__(self, path: str):
        import sentencepiece

        if Path(path).stat().st_size > MODEL_BYTES:
            raise ValueError(f"{path} is larger than {MODEL_BYTES} bytes")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(" A  b\tﬁ\n ") != f"{MARK}{MARK}A{MARK}{MARK}b\tﬁ\n{MARK}":
            raise ValueError("only models without normalisation, with a dummy prefix, are supported")
        n = sp.vocab_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.byte = [-1] * 256
        self.score: dict[str, tuple[float, int]] = {}
        for i, t in enumerate(self.text):
            if sp.is_byte(i):
                self.byte[int(t[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.score[t] = (-sp.get_score(i), i)
        if sp.get_score(self.score[max(self.score, key=len)][1]) == 0 or min(self.byte) < 0:
            raise ValueError("only merge-type models with byte fallback are supported")
        self.control = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        #: Pieces that merging their own characters gives; no other is ever a token.
        self.tokens = []
        #: Of a piece: its rank (-1 for a character) and the two pieces of its last merge.
        self.rank, self.parts = {}, {}
        for rank, (t, (_, i)) in enumerate(sorted(self.score.items(), key=lambda x: x[1])):
            self.score[t] = (rank, i)
        for t, (rank, i) in self.score.items():
            whole = merge(t, self.score, undone := [])
            if whole == [t]:
                self.tokens.append((t, i))
            self.rank[t], self.parts[t] = (rank, undone[-1]) if len(t) > 1 and whole == [t] else (-1, (t, t))
        pairs = {p[k : k + 2] for p in self.score for k in range(len(p) - 1)}
        inside = {c for p in self.score if len(p) > 1 for c in p}
        lone = "".join(c for c in "\n\t\r" if c not in inside)
        signs = set(string.punctuation) - {p[1] for p in pairs if p[0].isalpha()}
        if any(p[1] == MARK != p[0] for p in pairs):
            self.segment = r"(?s).+"
        else:
            # No piece crosses from another character to a space mark, nor from a letter to a sign, nor holds a lone character.
            lone, sign = re.escape(lone), re.escape("".join(sorted(signs)))
            other = f"[^{MARK}{lone}{sign}]"
            more = rf"(?:{other}+|(?<![^\W\d_])[{sign}])*" if sign else f"{other}*"
            self.segment = "|".join([f"[{lone}]"] * bool(lone) + [f"{MARK}+{more}", f"{other}{more}"] + [f"[{sign}]{more}"] * bool(sign))


@lru_cache(4)
def load(path: str) -> Model:
    return Model(path)


def merge(text: str, score: dict[str, tuple[float, int]], log: list | None = None) -> list[str]:
    """The pieces that merging leaves: always the adjacent pair of best score, the leftmost of equals. ``log`` gets the pairs."""
    part = list(text)
    n = len(part)
    if n < 2:
        return part
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(*s[:1], i, part[i], part[i + 1]) for i in range(n - 1) if (s := score.get(part[i] + part[i + 1]))]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or part[i] != a or part[j] != b:
            continue
        part[i], alive[j], after[i] = a + b, False, after[j]
        if log is not None:
            log.append((a, b))
        if after[i] < n:
            before[after[i]] = i
            if s := score.get(part[i] + part[after[i]]):
                heapq.heappush(heap, (s[0], i, part[i], part[after[i]]))
        if (h := before[i]) >= 0 and (s := score.get(part[h] + part[i])):
            heapq.heappush(heap, (s[0], h, part[h], part[i]))
    return [p for p, ok in zip(part, alive, strict=True) if ok]


class Codec:
    """Encodes and decodes in one worker."""

    def __init__(self, model: Model):
        self.m = model
        self.find = ahocorasick.Automaton()
        for t, i in model.tokens:
            self.find.add_word(t, (len(t), i))
        self.find.make_automaton()
        known = dict(model.tokens)
        #: Of a token: the longest token that its text begins with, besides itself.
        self.shorter = {i: next(((k, known[t[:k]]) for k in range(len(t) - 1, 0, -1) if t[:k] in known), None) for t, i in model.tokens}
        self.fits: dict[tuple[int, int], bool] = {}
        self.split = re.compile(model.segment).findall
        self.pack = struct.pack
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.young_bytes = 0
        body = [b"" if i in model.control else t.replace(MARK, " ").encode() for i, t in enumerate(model.text)]
        for v, i in enumerate(model.byte):
            body[i] = bytes([v])
        body[model.unk] = " ⁇ ".encode()  # how the library writes an unknown id
        self.size = np.array([len(b) for b in body], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.body = np.frombuffer(b"".join(body), np.uint8)
        self.is_byte = np.zeros(len(body), bool)
        self.is_byte[model.byte] = True
        self.marked = np.array([t.startswith(MARK) for t in model.text])
        self.shown = self.size > 0

    def _text(self, token: int) -> str:
        n = len(self.m.text)
        return self.m.text[token] if token < n else chr(token - n)

    def _fit(self, left: int, right: int) -> bool:
        """Whether merging the two tokens' text gives the two back.

        Undoes their merges, the latest first, and looks whether what then meets
        at the border would have merged before the merge just undone.
        """
        ok = self.fits.get((left, right))
        if ok is None:
            if len(self.fits) > FITS:
                self.fits.clear()
            score, rank, parts = self.m.score, self.m.rank, self.m.parts
            a, b = self._text(left), self._text(right)
            before, ok = float("inf"), True
            while ok:
                if (s := score.get(a + b)) and s[0] < before:
                    ok = False
                elif (x := rank.get(a, -1)) > (y := rank.get(b, -1)):
                    before, a = x, parts[a][1]  # of equal merges the left one comes first
                elif y >= 0:
                    before, b = y + 1, parts[b][0]
                else:
                    break
            self.fits[left, right] = ok
        return ok

    def backtrack(self, text: str) -> list[int]:
        """Token ids of one segment; a character without a piece is the vocabulary's size plus its code point."""
        n, base = len(text), len(self.m.text)
        longest: list = [None] * n
        for end, hit in self.find.iter(text):
            longest[end + 1 - hit[0]] = hit  # ends come in order, so the last is the longest
        fits = self.fits
        failed = 0  # bit i: no compatible sequence goes on from i
        out: list[int] = []
        hits: list[tuple[int, int]] = []
        pos, last, hit = 0, -1, longest[0]
        while True:
            hit = hit or (1, base + ord(text[pos]))
            while hit:
                size, token = hit
                if not failed >> (pos + size) & 1 and (last < 0 or (ok := fits.get((last, token))) or (ok is None and self._fit(last, token))):
                    break
                hit = self._next(hit, text[pos])
            if hit:
                out.append(token)
                hits.append(hit)
                pos += size
                if pos == n:
                    return out
                last, hit = token, longest[pos]
            else:
                failed |= 1 << pos
                out.pop()  # some sequence exists, so there is one to take back
                back = hits.pop()
                pos -= back[0]
                last = out[-1] if out else -1
                hit = self._next(back, text[pos])
                while hit is None:  # the token taken back was the shortest there
                    failed |= 1 << pos
                    out.pop()
                    back = hits.pop()
                    pos -= back[0]
                    last = out[-1] if out else -1
                    hit = self._next(back, text[pos])

    def _next(self, hit: tuple[int, int], char: str) -> tuple[int, int] | None:
        """The next shorter match where ``hit`` is one."""
        if hit[0] == 1:
            return None
        return self.shorter[hit[1]] or (1, len(self.m.text) + ord(char))

    def _segment(self, s: str) -> bytes:
        """Ids of a segment, as little-endian 32-bit integers."""
        if s.startswith(MARK * 2) or MARK in s[1:]:
            # Pieces of space marks alone break the order of merges that the search relies on.
            score, n = self.m.score, len(self.m.text)
            tokens = [score[p][1] if p in score else n + ord(p) for p in merge(s, score)]
        else:
            tokens = self.backtrack(s)
        n = len(self.m.text)
        if max(tokens) >= n:
            tokens = [i for t in tokens for i in ([t] if t < n else [self.m.byte[b] for b in chr(t - n).encode()])]
        return self.pack(f"<{len(tokens)}I", *tokens)

    def _kept(self, s: str) -> bytes:
        got = self.old.get(s)
        if got is None:
            got = self._segment(s)
        if len(s) < 64:
            if self.young_bytes >= CACHE:
                self.old, self.young, self.young_bytes = self.young, {}, 0
            self.young[s] = got
            self.young_bytes += ENTRY + len(s) + len(got)
        return got

    def encode(self, text: str) -> bytes:
        """Ids with the begin and end ids, as little-endian 32-bit integers."""
        out = [np.uint32(self.m.bos).tobytes()]
        if text:
            kept = self._kept
            out += [self.young.get(s) or kept(s) for s in self.split(MARK + text.replace(" ", MARK))]
        out.append(np.uint32(self.m.eos).tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids, in UTF-8; broken byte runs become U+FFFD, one for each byte."""
        given, ids = ids, ids[self.shown[ids]]
        if not len(ids):
            return b""
        size, start = self.size[ids], self.start[ids]
        to = np.cumsum(size) - size
        at = np.arange(to[-1] + size[-1]) + np.repeat(start - to, size)
        out = self.body[at].tobytes()
        if self.is_byte[ids].any():
            try:
                if not self.shown[given[1:-1]].all():  # an id without text ends a run of bytes
                    raise UnicodeError
                out.decode()
            except UnicodeError:
                out = self._repaired(given)
        return out[1:] if self.marked[ids[0]] else out

    def _repaired(self, ids: np.ndarray) -> bytes:
        out, run = [], bytearray()

        def close() -> None:
            i = 0
            while i < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + n]).decode().encode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�".encode())
                    i += 1
            run.clear()

        for t in ids.tolist():
            b = self.body[self.start[t] : self.start[t] + self.size[t]].tobytes()
            if self.is_byte[t]:
                run += b
            else:
                close()
                out.append(b)
        close()
        return b"".join(out)


def codec(model: Model) -> Codec:
    """This worker's codec; what it has kept serves later batches and tasks, until another operator's tables take its place."""
    return scan.held(("pieces", id(model)), lambda: (model, Codec(model)))[1]


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids``: array<int> with the begin and end ids."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(load(path))

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        c = codec(model.value)
        rows = [c.encode(t) for t in utf8(b.column(b.schema.get_field_index(text))).to_pylist()]
        off = np.cumsum([0] + [len(r) // 4 for r in rows])
        return [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4")))]

    return extend(docs, [T.StructField(ids, T.ArrayType(T.IntegerType(), True), False)], one)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the column ``out``: the text of each row's ids (null: empty)."""
    ship(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(load(path))

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        c = codec(model.value)
        rows = [c.decode(np.array(r or [], np.int64)).decode(errors="replace") for r in b.column(b.schema.get_field_index(ids)).to_pylist()]
        return [pa.array(rows, pa.string())]

    return extend(df, [T.StructField(out, T.StringType(), False)], one)


def round_trip(docs: DataFrame, path: str, text: str = "text", with_ids: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 and decoded_sha256, and the ids if asked for: encode and decode in one pass."""
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(load(path))

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        c = codec(model.value)
        size, enc, dec, rows = [], [], [], []
        for t in utf8(b.column(b.schema.get_field_index(text))).to_pylist():
            ids = c.encode(t)
            size.append(len(ids) // 4)
            enc.append(hashlib.sha256(ids).hexdigest())
            dec.append(hashlib.sha256(c.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            rows.append(ids if with_ids else b"")
        out = [pa.array(size, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())]
        if with_ids:
            off = np.cumsum([0, *size])
            out.append(pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.frombuffer(b"".join(rows), "<i4"))))
        return out

    fields = [T.StructField("n_tokens", T.LongType(), False), T.StructField("ids_sha256", T.StringType(), False), T.StructField("decoded_sha256", T.StringType(), False)]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType(), True), False))
    return extend(docs, fields, one, keep)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, encoded and decoded with the 32k merge-type model."""
    import public_tokenizers

    from tessera.runtime import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
