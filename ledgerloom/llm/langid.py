"""Language identification: script ranges narrow the candidates, and Viterbi over word scores labels the spans of a text.

* **Model.** Byte n-grams (two to four) of words with their borders are counted per language in a fixed number of hashed buckets, together
  with each language's letters per script. It is fitted on at most ``rows_per_language`` labelled documents of each language, chosen by a
  hash of the id; every label is kept. The model's size is languages x buckets, whatever the size of the corpus, and only it is broadcast.
* **Words.** A word's script is that of its first letter. Languages that hardly use the script are no candidates for it; the others score
  the mean log likelihood of its n-gram orders. Words without letters, or in a script that no language uses, are neutral.
* **Viterbi.** A path pays ``penalty`` for each change of language between words; the best path's runs are the spans. Texts of a slice step
  together, one word at a time.
* **Prediction.** The language with the most letters in its spans (ties: the smaller name); its share of all letters is the score.

Held out from fitting: documents whose crc32(doc_id as text) modulo 4 is 2. A prediction sees the text only.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a null id counts as the empty text for the hash; with no
labelled document at all every text is ``und``; equal rows get equal results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.textkit import mix, slices, span_hashes, text_bytes, word_spans

# First code points of script ranges, in rising order; a range ends where the next one begins.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"),
    (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"),
    (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x31A0, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD800, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"),
    (0x10000, "other"), (0x20000, "han"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
_ORDERS = (2, 3, 4)


@dataclass(frozen=True)
class LangParams:
    rows_per_language: int = 2000
    buckets: int = 1 << 16
    penalty: float = 6.0
    least_script_share: float = 0.002
    foreign: float = -30.0  # score of a language that does not use the word's script


@dataclass(frozen=True)
class LangModel:
    languages: tuple[str, ...]
    scores: np.ndarray = field(repr=False)  # (buckets, languages) log likelihoods
    allowed: np.ndarray = field(repr=False)  # (scripts, languages)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


class Words:
    """The words of a slice: the distinct ones as byte n-gram features, and each place's distinct word."""

    def __init__(self, column: pa.Array, buckets: int):
        data, off = text_bytes(column)
        starts, ends, self.first = word_spans(data, off)
        _, index, inverse = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        self.which = inverse
        s, size = starts[index], (ends - starts)[index]
        self.count = len(s)
        # every distinct word between two blanks
        base = np.concatenate([[0], np.cumsum(size + 2)])
        self.word_of = np.repeat(np.arange(len(s)), size + 2)
        inner = np.arange(base[-1]) - base[self.word_of] - 1
        real = (inner >= 0) & (inner < size[self.word_of])
        chars = np.full(base[-1], 32, dtype=np.uint8)
        chars[real] = data[(s[self.word_of] + inner)[real]]
        self._base, self._size, self._chars, self._shift = base, size, chars, np.uint64(64 - (buckets - 1).bit_length())
        points = np.frombuffer(chars.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        blank = np.flatnonzero(points == 32)
        bounds = blank[1::2]  # the closing blank of each word
        is_letter = _letters()[points]
        counted = np.concatenate([[0], np.cumsum(is_letter)])
        opens = np.concatenate([[0], bounds[:-1] + 1]) if len(bounds) else bounds
        self.letters = counted[bounds] - counted[opens] if len(bounds) else np.zeros(0, np.int64)
        places = np.flatnonzero(is_letter)
        first_letter = np.searchsorted(places, opens)
        self.script = np.full(self.count, -1)
        has = self.letters > 0
        codes = np.array([c for c, _ in SCRIPTS])
        names = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])
        if has.any():
            self.script[has] = names[np.searchsorted(codes, points[places[first_letter[has]]], side="right") - 1]

    def features(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(bucket, distinct word) of all n-grams, an order at a time, in word order."""
        wide = self._chars.astype(np.uint64)
        for n in _ORDERS:
            m = len(wide) - n + 1
            if m <= 0:
                continue
            key = np.full(m, n, dtype=np.uint64)
            for j in range(n):
                key = (key << np.uint64(8)) | wide[j : j + m]
            inside = self.word_of[:m] == self.word_of[n - 1 :]
            yield (mix(key[inside]) >> self._shift).astype(np.int64), self.word_of[:m][inside]


def _trainer(p: LangParams, languages: tuple[str, ...]):
    """Counts of n-gram buckets, and from ``p.buckets`` on letters by script, of each language in each slice; only what occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: i for i, name in enumerate(languages)}
        for piece in (s for b in batches for s in slices(b, "text")):
            words = Words(piece.column("text"), p.buckets)
            if not words.count:
                continue
            lang = np.repeat(np.array([number[x] for x in piece.column("lang").to_pylist()]), np.diff(words.first))
            lettered = words.script >= 0
            features = [(bucket[lettered[word]], word[lettered[word]]) for bucket, word in words.features()]
            for i in np.unique(lang):
                counts = np.bincount(words.which[lang == i], minlength=words.count)
                total = np.zeros(p.buckets + len(SCRIPT_NAMES))
                total[p.buckets :] = np.bincount(words.script[lettered], (counts * words.letters)[lettered], minlength=len(SCRIPT_NAMES))
                for bucket, word in features:
                    total[: p.buckets] += np.bincount(bucket, counts[word], minlength=p.buckets)
                j = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(j), i, np.int32)), pa.array(j.astype(np.int32)), pa.array(total[j])], names=["lang_no", "bucket", "n"]
                )

    return run


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, p: LangParams) -> LangModel | None:
    labelled = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").count().collect()
    sizes = {r["lang"]: r["count"] for r in counts}
    if not sizes:
        return None
    languages = tuple(sorted(sizes))
    limits = F.create_map(*[F.lit(x) for name, n in sizes.items() for x in (name, int(1_000_000 * min(1.0, p.rows_per_language / n)) + 1)])
    chosen = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) < limits[F.col("lang")]).select("text", "lang")
    tasks = max(1, sum(min(n, p.rows_per_language) for n in sizes.values()) // 1000)
    sums = chosen.repartition(min(tasks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(_trainer(p, languages), "lang_no int, bucket int, n double")
    table = sums.groupBy("lang_no", "bucket").agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros((len(languages), p.buckets + len(SCRIPT_NAMES)))
    totals[table["lang_no"], table["bucket"]] = table["n"]
    grams, scripts = totals[:, : p.buckets], totals[:, p.buckets :]
    smooth = grams + 0.5
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1.0)
    scores = np.log(smooth / smooth.sum(axis=1, keepdims=True)).T / len(_ORDERS)
    return LangModel(languages, np.ascontiguousarray(scores.astype(np.float32)), (share >= p.least_script_share).T)


def word_scores(words: Words, model: LangModel, p: LangParams) -> np.ndarray:
    """(distinct words, languages)."""
    total = np.zeros((words.count, len(model.languages)))
    for bucket, word in words.features():
        for i in range(len(model.languages)):
            total[:, i] += np.bincount(word, model.scores[bucket, i], minlength=words.count)
    # only differences between languages count
    total -= total.max(axis=1, keepdims=True)
    allowed = np.zeros_like(total, dtype=bool)
    allowed[words.script >= 0] = model.allowed[words.script[words.script >= 0]]
    total = np.where(allowed, total, np.minimum(total, 0) + p.foreign)
    total[~allowed.any(axis=1)] = 0.0
    return total


def viterbi(scores: np.ndarray, which: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Labels of all places of all texts; texts of equal standing step together, the longest first."""
    labels = np.zeros(len(which), dtype=np.int64)
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    base, sizes = first[:-1][order], sizes[order]
    going = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")  # texts with a word at each step
    if not len(going):
        return labels
    switched = np.zeros((len(which), scores.shape[1]), dtype=bool)
    source = np.zeros(len(which), dtype=np.int16)
    value = scores[which[base[: going[0]]]]
    for t in range(1, len(going)):
        k = going[t]
        at = base[:k] + t
        now = value[:k]
        best = now.argmax(axis=1)
        changed = now[np.arange(k), best][:, None] - penalty
        switched[at] = now < changed
        source[at] = best
        value[:k] = np.maximum(now, changed) + scores[which[at]]
    state = value.argmax(axis=1)
    for t in range(len(going) - 1, 0, -1):
        k = going[t]
        at = base[:k] + t
        now = state[:k]
        labels[at] = now
        state[:k] = np.where(switched[at, now], source[at], now)
    labels[base[: going[0]]] = state
    return labels


def _predictor(p: LangParams, shared, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LangModel | None = shared.value
        for piece in (s for b in batches for s in slices(b, "text")):
            rows = piece.num_rows
            names, score, spans = ["und"] * rows, np.zeros(rows), [[] for _ in range(rows)]
            if model is not None:
                words = Words(piece.column("text"), p.buckets)
                count = len(model.languages)
                labels = viterbi(word_scores(words, model, p), words.which, words.first, p.penalty)
                text = np.repeat(np.arange(rows), np.diff(words.first))
                letters = words.letters[words.which]
                mass = np.bincount(text * count + labels, letters, minlength=rows * count).reshape(rows, count)
                total, best = mass.sum(axis=1), mass.argmax(axis=1)
                score = np.where(total > 0, mass.max(axis=1) / np.maximum(total, 1), 0.0)
                names = [model.languages[b] if n else "und" for b, n in zip(best, total)]
                if with_spans:
                    for i, (a, b) in enumerate(zip(words.first[:-1], words.first[1:])):
                        cuts = [0, *(np.flatnonzero(labels[a + 1 : b] != labels[a : b - 1]) + 1), b - a] if b > a else []
                        spans[i] = [{"lang": model.languages[labels[a + x]], "first": int(x), "end": int(y)} for x, y in zip(cuts[:-1], cuts[1:])]
            columns = [piece.column("doc_id"), piece.column("held_out"), pa.array(names, pa.string()), pa.array(score)]
            names_out = ["doc_id", "held_out", "lang_pred", "score"]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("end", pa.int32())]))))
                names_out.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=names_out)

    return run


def predict(docs: DataFrame, model: LangModel | None, p: LangParams = LangParams(), with_spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score and, if asked for, the spans (language, first word, end) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = ", spans array<struct<lang:string,first:int,end:int>>" if with_spans else ""
    return rows.mapInArrow(_predictor(p, shared, with_spans), f"doc_id {kind}, held_out boolean, lang_pred string, score double{spans}")


def identify(docs: DataFrame, p: LangParams = LangParams(), with_spans: bool = False) -> DataFrame:
    """Fits on the labelled documents that are not held out and predicts all."""
    return predict(docs, fit(docs, p), p, with_spans)
