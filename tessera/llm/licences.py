"""Licence notices in documents: phrases, and an exact set-similarity join with templates.

A text block is a window of WIDER times a template's words, one window beginning
at every word of the text (a shorter text is one block). A block matches if it
contains at least CONTAINMENT of the template's distinct words, and each of the
template's telling phrases whole: the words that tell a licence from its
relatives, such as the version. Blocks that match and follow one another are
given as one.

Tokens are ordered by their count over all documents, the rarest first. A text
with a match must hold one of the first |T| - need + 1 tokens (prefix filter) and
at least ``need`` distinct ones (length filter), and while its tokens are counted
in that order it is given up as soon as the rest cannot make up for those
missing (positional filter). Of what is left, the distinct words of all windows
are counted at once: a word's place counts for the windows that begin after the
word's place before and reach it.

Only counts of template words and the templates themselves, both bounded by the
templates' size, go through the driver. Each text is scanned whole in one task.

Defined results: null and empty texts have no words, no places, empty labels and
score 0; the score is the best containment found, 1 for a phrase; repeated rows
are each reported; further columns stay, but for those with the names of new ones.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import scan
from tessera.llm.notices import TEMPLATES
from tessera.llm.scan import U, extend, utf8
from tessera.runtime import ship, table

CONTAINMENT = 0.8
#: Words of a block, as a multiple of the template's words.
WIDER = 1.25

Template = tuple[str, str, tuple[str, ...]]

# The phrases, whose words stand consecutively, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


def hashes(tokens: list[str]) -> np.ndarray:
    out = []
    for t in tokens:
        b = np.frombuffer(t.encode(), np.uint8)
        with np.errstate(over="ignore"):
            out.append(scan.word_hashes(b, np.array([0]), np.array([len(b)]))[0])
    return np.array(out, U)


class Lookup:
    """Which words of a block of texts are among some tokens."""

    def __init__(self, tokens: list[str]):
        h = hashes(tokens)
        order = np.argsort(h)
        self.hash, self.token = h[order], np.arange(len(tokens))[order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(h >> U(48)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, tokens)."""
        at = np.flatnonzero(self.maybe[(h >> U(48)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.hash, h[at]), len(self.hash) - 1)
        ok = self.hash[i] == h[at]
        return at[ok], self.token[i[ok]]


def token_counts(docs: DataFrame, tokens: list[str]) -> list[int]:
    """How often each token stands in all texts; one partial row of each task and token."""
    ship(docs.sparkSession)

    @scan.tidied
    def count(batches):
        look, total = Lookup(tokens), np.zeros(len(tokens), np.int64)
        for b in batches:
            for _, _, buf, off in scan.blocks(utf8(b.column(0))):
                starts, ends, _ = scan.word_spans(buf, off, scan.ALNUM)
                with np.errstate(over="ignore"):
                    total += np.bincount(look.find(scan.word_hashes(buf, starts, ends))[1], minlength=len(tokens))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["token", "n"])

    got = docs.select("text").mapInArrow(count, "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    n = dict(map(tuple, got))
    return [n.get(i, 0) for i in range(len(tokens))]


def bounds(template: Template, containment: float = CONTAINMENT) -> tuple[list[str], int, int]:
    """A template's distinct words, how many of them a block needs, and the words of a block."""
    w = words(template[1])
    distinct = sorted(set(w))
    return distinct, int(np.ceil(containment * len(distinct) - 1e-9)), int(np.ceil(WIDER * len(w) - 1e-9))


class Matcher:
    """Phrases and templates, with tokens in global order of frequency."""

    def __init__(self, templates: list[Template], count: dict[str, int], containment: float = CONTAINMENT):
        self.templates = []
        for t in templates:
            distinct, need, width = bounds(t, containment)
            order = sorted(distinct, key=lambda w: (count.get(w, 0), w))
            self.templates.append((t[0], order, frozenset(order), need, width, [p.split() for p in t[2]]))
        self.phrases = [(p.split(), label) for p, label in PHRASES.items()]
        rare = {w: [] for p, _ in self.phrases for w in p[-1:]}
        for i, (_, order, _, need, _, _) in enumerate(self.templates):
            for w in order[: len(order) - need + 1]:
                rare.setdefault(w, []).append(i)
        self.rare = rare
        self.look = Lookup(list(rare))

    def phrase_places(self, w: list[str]) -> list[tuple[int, str]]:
        return [(i, label) for p, label in self.phrases for i in _places(w, p)]

    def blocks(self, w: list[str]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end word, best containment) of the matching blocks, those in a row as one."""
        at: dict[str, list[int]] = {}
        for pos, word in enumerate(w):
            at.setdefault(word, []).append(pos)
        out = []
        for i in sorted({i for word in at for i in self.rare.get(word, ())}):
            label, order, distinct, need, width, tells = self.templates[i]
            if len(at) < need or not _enough(order, at, need):
                continue
            told = [_places(w, p, at) for p in tells]
            if not all(told):
                continue
            last = max(len(w) - width, 0)
            found = np.zeros(last + 2, np.int32)
            for t in distinct & at.keys():
                _cover(found, np.array(at[t]), 1, width, last)
            found = np.cumsum(found[:-1])
            ok = found >= need
            for p, places in zip(tells, told, strict=True):
                whole = np.zeros(last + 2, np.int32)
                _cover(whole, np.array(places), len(p), width, last)
                ok &= np.cumsum(whole[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], ok, [False]])))
            for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                out.append((label, a, min(len(w), z - 1 + width), int(found[a:z].max()) / len(order)))
        return out


def _places(w: list[str], phrase: list[str], at: dict[str, list[int]] | None = None) -> list[int]:
    begins = range(len(w) - len(phrase) + 1) if at is None else at.get(phrase[0], ())
    return [i for i in begins if w[i] == phrase[0] and w[i : i + len(phrase)] == phrase]


def _enough(order: list[str], at: dict[str, list[int]], need: int) -> bool:
    """Whether a text has ``need`` of the tokens, the rarest looked at first."""
    spare = len(order) - need
    for t in order:
        if t not in at:
            spare -= 1
            if spare < 0:
                return False
    return True


def _cover(sums: np.ndarray, places: np.ndarray, size: int, width: int, last: int) -> None:
    """Adds, as differences, one to each window's beginning from which one of the places (each of ``size`` words) is the first inside."""
    begin = np.maximum(np.concatenate([[0], places[:-1] + 1]), places + size - width)
    end = np.minimum(places, last)
    ok = begin <= end
    np.add.at(sums, begin[ok], 1)
    np.add.at(sums, end[ok] + 1, -1)


BLOCK = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType()), T.StructField("containment", T.DoubleType())])
FIELDS = [
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_base", T.LongType(), False),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType(), False),
    T.StructField("labels", T.StringType(), False),
    T.StructField("score", T.DoubleType(), False),
    T.StructField("blocks", T.ArrayType(BLOCK), False),
]
_BLOCKS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("containment", pa.float64())]))


def scan_licences(docs: DataFrame, templates: list[Template] = TEMPLATES, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with the places of the phrases and the blocks that match templates; see FIELDS."""
    ship(docs.sparkSession)
    tokens = sorted({w for _, t, _ in templates for w in words(t)})
    count = dict(zip(tokens, token_counts(docs, tokens), strict=True))
    shared = docs.sparkSession.sparkContext.broadcast(Matcher(templates, count))

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        m = shared.value
        rows = []
        t = utf8(b.column(b.schema.get_field_index("text")))
        for lo, _, buf, off in scan.blocks(t):
            starts, ends, at = scan.word_spans(buf, off, scan.ALNUM)
            with np.errstate(over="ignore"):
                hit = m.look.find(scan.word_hashes(buf, starts, ends))[0]
            some = np.diff(np.searchsorted(hit, at)) > 0
            for i, n in enumerate(np.diff(at).tolist()):
                if not some[i]:
                    rows.append((n, 0, None, None, "", "", 0.0, []))
                    continue
                w = words(t[lo + i].as_py())
                base, blocks = m.phrase_places(w), m.blocks(w)
                places = [p for p, _ in base]
                own = {x for _, x in base}
                score = 1.0 if base else max((x[3] for x in blocks), default=0.0)
                rows.append((n, len(base), min(places, default=None), max(places, default=None), ",".join(sorted(own)), ",".join(sorted(own | {x[0] for x in blocks})), score, [dict(zip(BLOCK.names, x, strict=True)) for x in blocks]))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _BLOCKS]
        return [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]

    return extend(docs, FIELDS, one, keep)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    return scan_licences(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"]).drop("blocks")
