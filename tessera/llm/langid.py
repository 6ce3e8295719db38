"""Language identification that labels spans of mixed-language text.

The scripts of a word's letters narrow the languages to those that use the
script. Each word then gets a score from every candidate, the log-likelihood of
its character trigrams, and a Viterbi pass over the words, in which a change of
language costs a penalty, labels the spans.

The model is a naive Bayes table over hashed trigrams, fitted to a sample of
labelled rows. Words of a batch of texts are scored together, and the Viterbi
pass takes one step of all texts at once, so no Python object is made per word.

A text's words are scored for the languages that use one of its scripts only. A
text too long for that in one piece is gone through in parts: the scores at each
part's border are kept, and the way back works each part out again.

Defined results: null texts and texts without a letter are ``und`` with score 0
and no spans; texts are taken whole; equal scores go to the language that sorts
first; without labelled rows every text is ``und``; with more than
MOST_LANGUAGES the commonest are learned; further columns stay, but for those with
the names of new ones.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import scan
from tessera.llm.scan import extend, utf8
from tessera.runtime import ship, table

#: Labelled rows of each language that the model is fitted to, about: chosen by a hash of doc_id.
SAMPLE_ROWS = 1500
#: Languages that a model holds, the commonest; its table has 256 KB for each.
MOST_LANGUAGES = 500
#: Scores of words (one for each candidate language) that are held at once, about.
CELLS = 4 << 20
#: Buckets of trigrams.
BUCKETS = 1 << 16
#: Cost, in nats, of a change of language between two words.
SWITCH = 8.0
#: Added to each trigram's count.
SMOOTH = 0.05
#: A language uses a script if so many of its letters are in it.
SCRIPT_SHARE = 0.02
UND = "und"

# First code points of Unicode's larger blocks of letters, and the script from there on.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"),
    (0x0800, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"),
    (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"),
    (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Cherokee"), (0x1400, "Canadian"),
    (0x1680, "Other"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Canadian"), (0x1900, "Other"),
    (0x1C80, "Cyrillic"), (0x1C90, "Georgian"), (0x1CC0, "Other"), (0x1D00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Other"), (0x2C60, "Latin"), (0x2C80, "Coptic"), (0x2D00, "Georgian"), (0x2D30, "Tifinagh"),
    (0x2D80, "Ethiopic"), (0x2DE0, "Cyrillic"), (0x2E80, "Han"), (0x3040, "Hiragana"), (0x30A0, "Katakana"),
    (0x3100, "Bopomofo"), (0x3130, "Hangul"), (0x3190, "Han"), (0x31F0, "Katakana"), (0x3200, "Han"),
    (0xA000, "Yi"), (0xA4D0, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"),
    (0xA800, "Other"), (0xAB30, "Latin"), (0xAB70, "Cherokee"), (0xABC0, "Other"), (0xAC00, "Hangul"),
    (0xD7FC, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Katakana"),
    (0xFFA0, "Hangul"), (0x10000, "Other"), (0x20000, "Han"), (0x32000, "Other"),
]
_NAMES = sorted({s for _, s in SCRIPTS})
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Of each code point: 0 if it is no part of a word, else 1 + the number of its script; marks are parts of words too."""
    if not _tables:
        out = np.zeros(sys.maxunicode + 1, np.uint8)
        ends = [a for a, _ in SCRIPTS[1:]] + [sys.maxunicode + 1]
        for (a, s), b in zip(SCRIPTS, ends, strict=True):
            out[a:b] = 1 + _NAMES.index(s)
        letter = np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
        _tables.append(np.where(letter, out, 0).astype(np.uint8))
    return _tables[0]


def _is_letter() -> np.ndarray:
    if len(_tables) < 2:
        _letters()
        _tables.append(np.fromiter((unicodedata.category(chr(i))[0] == "L" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _tables[1]


@dataclass
class Words:
    """The words of a run of texts."""

    trigrams: np.ndarray  # bucket of each trigram, those of a word together
    first: np.ndarray  # of each word, its first trigram
    script: np.ndarray
    letters: np.ndarray
    at: np.ndarray  # of each text, its first word; one more at the end
    start: np.ndarray  # of each word, its first and end character in its text
    end: np.ndarray


def _without_stray_marks(cp: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """``kind`` with 0 for marks that no letter precedes in their run."""
    letter = _is_letter()[cp] & (kind > 0)
    inside = kind > 0
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    stray = first[~letter[first]]
    if len(stray):
        kind = kind.copy()
        for a in stray.tolist():
            while kind[a] and not letter[a]:
                kind[a] = 0
                a += 1
    return kind


def words_of(texts: list[str]) -> Words:
    """Maximal runs of letters and marks that begin with a letter, lower-cased; texts keep apart."""
    low = [t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
    cp = np.frombuffer("\0".join(["", *low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _without_stray_marks(cp, _letters()[cp])
    inside = kind > 0
    first = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    base = np.cumsum([1] + [len(t) + 1 for t in low])
    # A trigram stands for each letter, with what is before and after; borders count as zero.
    c = np.where(inside, cp, 0)
    mid = np.flatnonzero(inside)
    code = (c[mid - 1].astype(np.uint64) * np.uint64(0x9E3779B1) + c[mid].astype(np.uint64)) * np.uint64(0x85EBCA6B) + c[mid + 1].astype(np.uint64)
    tri = (scan.mix(code) % np.uint64(BUCKETS)).astype(np.int32)
    size = end - first
    at = np.searchsorted(first, base)
    text = np.searchsorted(base, first, side="right") - 1
    return Words(tri, np.cumsum(size) - size, kind[first].astype(np.int64) - 1, size, at, first - base[text], end - base[text])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (BUCKETS, languages) log-probabilities
    scripts: np.ndarray  # (scripts, languages): 0 where the language uses it, else a large cost; 0 throughout where none does

    def label(self, texts: list[str], switch: float = SWITCH) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]]]:
        """The prevailing language, its share of the letters, and (start, end, language) spans of each text."""
        langs, scores, spans = [], [], []
        if not self.langs:
            return [UND] * len(texts), [0.0] * len(texts), [[] for _ in texts]
        w = words_of(texts)
        # Languages that use a script of these words; the others have no part in them.
        some = np.flatnonzero((self.scripts[np.unique(w.script)] == 0).any(axis=0))
        most = max(CELLS // max(len(some), 1), 1)
        best = np.zeros(len(w.first), np.int16)
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(w.at, w.at[lo] + most, side="right")) - 1)
            a, b = int(w.at[lo]), int(w.at[hi])
            if b - a <= most:
                best[a:b] = viterbi(self._scores(w, a, b, some), w.at[lo : hi + 1] - a, switch)
            else:
                best[a:b] = viterbi_long(lambda x, y, a=a: self._scores(w, a + x, a + y, some), b - a, len(some), switch, most)
            lo = hi
        best = some[best] if len(some) else best
        for i in range(len(texts)):
            a, b = w.at[i], w.at[i + 1]
            if a == b:
                langs.append(UND)
                scores.append(0.0)
                spans.append([])
                continue
            mass = np.bincount(best[a:b], weights=w.letters[a:b], minlength=len(self.langs))
            top = int(mass.argmax())
            langs.append(self.langs[top])
            scores.append(float(mass[top] / mass.sum()))
            cut = np.concatenate([[a], np.flatnonzero(np.diff(best[a:b])) + a + 1, [b]])
            spans.append([(int(w.start[x]), int(w.end[y - 1]), self.langs[best[x]]) for x, y in zip(cut[:-1], cut[1:], strict=True)])
        return langs, scores, spans

    def _scores(self, w: Words, a: int, b: int, some: np.ndarray) -> np.ndarray:
        """Scores of the words from a to b for some languages; a part of the trigrams at a time."""
        out = np.empty((b - a, len(some)), np.float32)
        table = self.table if len(some) == len(self.langs) else self.table[:, some]
        edges = np.append(w.first, len(w.trigrams))
        step = max(CELLS // (8 * max(len(some), 1)), 1)
        for x in range(a, b, step):
            y = min(x + step, b)
            first = edges[x]
            out[x - a : y - a] = np.add.reduceat(table[w.trigrams[first : edges[y]]], w.first[x:y] - first, axis=0)
        out += self.scripts[w.script[a:b]][:, some]
        return out


def viterbi(word: np.ndarray, at: np.ndarray, switch: float) -> np.ndarray:
    """The best language of each word, by text; one step takes the next word of all texts that have one."""
    n, k = word.shape
    out = np.zeros(n, np.int16)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")
    first, size = at[:-1][order], size[order]
    if not n:
        return out
    stays = np.zeros((n, k), bool)
    prev = np.zeros(n, np.int16)  # the best language before each word
    live = np.searchsorted(-size, 0, side="left")
    score = word[first[:live]].astype(np.float64)
    for step in range(1, int(size[0])):
        # Texts are in order of falling size; finished ones keep their last score.
        m = int(np.searchsorted(-size, -step, side="left"))
        rows = first[:m] + step
        s = score[:m]
        top = s.argmax(axis=1)
        change = s[np.arange(m), top] - switch
        stay = s >= change[:, None]
        stays[rows] = stay
        prev[rows] = top
        score[:m] = np.where(stay, s, change[:, None]) + word[rows]
    state = score.argmax(axis=1)
    for step in range(int(size[0]) - 1, -1, -1):
        m = int(np.searchsorted(-size, -step, side="left"))
        rows = first[:m] + step
        now = state[:m]
        out[rows] = now
        if step:
            state[:m] = np.where(stays[rows, now], now, prev[rows])
    return out


def viterbi_long(scores, n: int, k: int, switch: float, part: int) -> np.ndarray:
    """The best language of each of n words of one text; ``scores`` gives those from one word to another."""
    begins = list(range(0, n, part))
    kept = []  # the scores before each part
    score = np.zeros(k)

    def forward(word, score, first):
        stays, prev = np.zeros(word.shape, bool), np.zeros(len(word), np.int16)
        for i, row in enumerate(word):
            if first and not i:
                score = row.astype(np.float64)
                continue
            top = score.argmax()
            change = score[top] - switch
            stays[i] = score >= change
            prev[i] = top
            score = np.where(stays[i], score, change) + row
        return score, stays, prev

    for a in begins:
        kept.append(score)
        score = forward(scores(a, min(a + part, n)), score, a == 0)[0]
    out = np.zeros(n, np.int16)
    now = int(score.argmax())
    for a, before in zip(reversed(begins), reversed(kept), strict=True):
        z = min(a + part, n)
        _, stays, prev = forward(scores(a, z), before, a == 0)
        for i in range(z - a - 1, -1, -1):
            out[a + i] = now
            if a + i and not stays[i, now]:
                now = int(prev[i])
    return out


def sample(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows of each non-null lang, by a hash of doc_id; texts are not shuffled."""
    docs = docs.where("lang is not null and text is not null")
    counts = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return docs
    share = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(1.0, rows / r.n))))
    return docs.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(1 << 20)) / float(1 << 20) < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))


def fit(docs: DataFrame) -> Model:
    """A model of the columns text and lang; counts are summed by Spark, the driver gets the table."""
    ship(docs.sparkSession)

    @scan.tidied
    def count(batches):
        seen: dict[str, np.ndarray] = {}
        used: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for t, lang in zip(utf8(b.column(1)).to_pylist(), langs, strict=True):
                w = words_of([t])
                if lang not in seen:
                    seen[lang], used[lang] = np.zeros(BUCKETS, np.int64), np.zeros(len(_NAMES), np.int64)
                seen[lang] += np.bincount(w.trigrams, minlength=BUCKETS)
                used[lang] += np.bincount(w.script, weights=w.letters, minlength=len(_NAMES)).astype(np.int64)
        for lang in seen:
            for kind, c in ((0, seen[lang]), (1, used[lang])):
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], names=["lang", "kind", "at", "n"])

    counts = docs.select("lang", "text").mapInArrow(count, "lang string, kind int, at int, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n"))

    def row(t: pa.Table) -> pa.Table:
        """A language's log-probabilities and its letters by script."""
        kind, at, n = (t[c].to_numpy() for c in ("kind", "at", "n"))
        grams, letters = np.zeros(BUCKETS), np.zeros(len(_NAMES), np.int64)
        grams[at[kind == 0]] = n[kind == 0]
        letters[at[kind == 1]] = n[kind == 1]
        logs = np.log((grams + SMOOTH) / (grams.sum() + SMOOTH * BUCKETS)).astype(np.float32)
        return pa.table({"lang": t["lang"].slice(0, 1), "words": pa.array([int(grams.sum())], pa.int64()), "logs": pa.array([logs.tobytes()], pa.binary()), "letters": pa.array([letters.tolist()], pa.list_(pa.int64()))})

    # A row for each language, with the commonest first.
    got = counts.groupBy("lang").applyInArrow(row, "lang string, words long, logs binary, letters array<long>").orderBy(F.desc("words"), "lang").limit(MOST_LANGUAGES).collect()
    got.sort(key=lambda r: r.lang)
    table = np.zeros((BUCKETS, len(got)), np.float32)
    scripts = np.zeros((len(_NAMES), len(got)))
    for i, r in enumerate(got):
        table[:, i] = np.frombuffer(r.logs, np.float32)
        scripts[:, i] = r.letters
    use = scripts >= SCRIPT_SHARE * scripts.sum(axis=0)
    cost = np.where(use | ~use.any(axis=1, keepdims=True), 0.0, -1e6)
    return Model([r.lang for r in got], table, cost.astype(np.float32))


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, spans: bool = True, names: tuple[str, str, str] = ("lang_pred", "score", "spans")) -> DataFrame:
    """``docs`` with lang_pred, score and, if asked for, the spans of each language in characters."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def one(b: pa.RecordBatch) -> list[pa.Array]:
        langs: list = []
        scores: list = []
        parts: list = []
        texts = utf8(b.column(b.schema.get_field_index(text)))
        for lo, hi, _, _ in scan.blocks(texts):
            with np.errstate(over="ignore"):
                x, y, z = shared.value.label(texts[lo:hi].to_pylist())
            langs += x
            scores += y
            parts += [[{"start": s, "end": e, "lang": g} for s, e, g in p] for p in z] if spans else []
        out = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
        return out + [pa.array(parts, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))] * spans

    fields = [T.StructField(names[0], T.StringType(), False), T.StructField(names[1], T.DoubleType(), False)] + [T.StructField(names[2], SPAN, False)] * spans
    return extend(docs, fields, one, keep)


def held_out(doc_id, folds: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 1, F.lit(False))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from the labelled documents whose crc32(doc_id) modulo 3 is not 1."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(sample(docs.where(~held_out("doc_id", 3))))
    out = identify(docs.select("doc_id", held_out("doc_id", 3).alias("held_out"), "text"), model, keep=["doc_id", "held_out"])
    return out
