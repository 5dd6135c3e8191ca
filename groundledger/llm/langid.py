"""Language identification by unigrams over a fixed public vocabulary, summed over all segmentations.

Each language has a probability for every piece of the vocabulary, learned from labelled texts. A word's probability in a
language is the sum over all ways to cut it into pieces (forward algorithm); a text's is the product over its words. The
score is the posterior of the best language under the shares of the labels. It knows the learned languages only, so a text in no
language has a score near 1 as well; ``surprise`` tells such texts. It says how far the text's log-likelihood per letter in the
best language is below the mean of the labelled texts of that language, in standard deviations for its length, as a share of how
far the strangest text of the sample is. So 1 is as strange as any text learned from.

A text is lower-cased and its words are the runs of letters. A null text, or one without letters, is ``und`` with score
0, and so is every text if nothing was learned. A tie goes to the language whose name sorts first. Runs of letters are
scored whole, whatever their length: only as many forward sums as the longest piece has letters are carried, scaled from time
to time. Rows with a null language or text teach nothing; repeated rows count each time. Other columns stay; one named like a
new column is replaced.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from .common import Memo, in_small_batches, settle, strips, with_columns

UND = "und"
LETTERS = regex.compile(r"\p{L}+")
#: Letters after which the forward sums of a longer run are scaled anew.
STRETCH = 48
#: Scale per letter that keeps products of probabilities inside the range of doubles.
LIFT = 24.0


def parts(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class PieceIndex:
    """Row of each piece, looked up for many substrings at a time: polynomial hashes of the code points (modulo 2**64) and
    a table in which every piece has one of two places."""

    BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
    BITS = 18

    def __init__(self, pieces: list[str]) -> None:
        self.longest = max(map(len, pieces), default=1)
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(self.longest + 1, self.BASE)], dtype=np.uint64)
        self.keys = np.zeros(1 << self.BITS, np.uint64)
        self.rows = np.full(1 << self.BITS, -1, np.int32)
        for row, piece in enumerate(pieces):
            self._put(self.prefixes(np.array([[ord(c) for c in piece]], np.uint64))[-1], row)

    def _put(self, h: np.ndarray, row: int) -> None:
        a, b = self._places(h)
        at = a if self.rows[a[0]] < 0 else b
        for _ in range(100):  # whoever held the place moves to its other one
            h, self.keys[at] = self.keys[at].copy(), h
            row, self.rows[at] = int(self.rows[at[0]]), row
            if row < 0:
                return
            a, b = self._places(h)
            at = b if a[0] == at[0] else a
        raise ValueError("the vocabulary is too large for its table")

    def prefixes(self, points: np.ndarray) -> list[np.ndarray]:
        """Hash of each beginning of the rows, the empty one first."""
        out = [np.zeros(len(points), np.uint64)]
        for k in range(points.shape[1]):
            out.append(out[-1] * self.BASE + points[:, k] + np.uint64(1))
        return out

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - self.BITS)).astype(np.int64), (mixed & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, prefix: list[np.ndarray], i: int, j: int, live: int) -> np.ndarray:
        """Rows of the substrings from ``i`` to ``j`` of the first ``live`` words, -1 where there is no such piece."""
        h = prefix[j][:live] - prefix[i][:live] * self.power[j - i]
        a, b = self._places(h)
        return np.where(self.keys[a] == h, self.rows[a], np.where(self.keys[b] == h, self.rows[b], -1))


@dataclass
class Model:
    """``prob[piece, language]``; the last row stands for a letter that is no piece."""

    languages: list[str]
    prior: np.ndarray
    pieces: dict[str, int]
    prob: np.ndarray
    #: Per language the mean log-likelihood of a letter, its variance between texts, that within them times letters, and the
    #: most standard deviations by which a text of the sample is below the mean (at least 1).
    usual: np.ndarray | None = None

    @cached_property
    def _tables(self) -> tuple[PieceIndex, np.ndarray]:
        index = PieceIndex(list(self.pieces))
        return index, self.prob * LIFT ** np.array([*map(len, self.pieces), 1])[:, None]

    def word_scores(self, words: list[str]) -> np.ndarray:
        """log P(word) per language: the forward sums of all words of a class of lengths together."""
        out = np.zeros((len(words), len(self.languages)))
        index, lifted = self._tables
        classes = defaultdict(list)  # up to 8, 16, 32, ... letters
        for i, w in enumerate(words):
            classes[max(3, (len(w) - 1).bit_length())].append(i)
        for where in classes.values():
            where = np.array(sorted(where, key=lambda i: -len(words[i])))  # so those not yet at their end come first
            lengths = np.array([len(words[i]) for i in where])
            most = int(lengths[0])
            points = np.array([words[i] for i in where], f"<U{most}").view("<u4").reshape(len(where), most).astype(np.uint64)
            prefix = index.prefixes(np.hstack([np.full((len(where), 1), ord("▁"), np.uint64), points]))
            forward = deque([np.ones((len(where), len(self.languages)))], index.longest)  # of the last places
            scale = -(lengths[:, None] + 1) * math.log(LIFT)
            for j in range(1, most + 2):
                live = int(np.searchsorted(-lengths, 1 - j, "right"))
                total = np.zeros((live, len(self.languages)))
                for k in range(1, len(forward) + 1):
                    row = index.find(prefix, j - k, j, live)
                    if k == 1:
                        total += forward[-1][:live] * lifted[row]  # -1 is the row of an unknown letter
                    elif len(hit := np.flatnonzero(row >= 0)):
                        total[hit] += forward[-k][hit] * lifted[row[hit]]
                forward.append(total)
                if j % STRETCH == 0:
                    top = np.maximum(np.max([f[:live] for f in forward], axis=0), 1e-300)
                    scale = scale[:live] + np.log(top)
                    for f in forward:
                        f[:live] /= top
                ended = slice(int(np.searchsorted(-lengths, -j, "right")), live)
                out[where[ended]] = np.log(np.maximum(total[ended], 1e-300)) + scale[ended]
        return out


def vocabulary(path: str) -> list[str]:
    """Pieces made of lower-case letters, with or without the word mark; the mark itself and single letters included."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    return [p for p in pieces if p == "▁" or (LETTERS.fullmatch(p.removeprefix("▁")) and p == p.lower())]


def _count_pieces(docs: DataFrame, path: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        count: dict[str, Counter] = defaultdict(Counter)
        memo = Memo(lambda new: sp.encode(new, out_type=str, num_threads=1), most=50_000)
        for batch in batches:
            for piece in strips(batch, 1):
                words: dict[str, Counter] = defaultdict(Counter)
                for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    words[lang].update(parts(text))
                for lang, seen in words.items():
                    memo.know(seen)
                    for w, n in seen.items():
                        for p in memo.known[w]:
                            count[lang][p] += n
        rows = [(lang, p, n) for lang, c in count.items() for p, n in c.items()]
        for at in range(0, len(rows), 50_000):
            lang, p, n = zip(*rows[at:at + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(p), pa.array(n, pa.int64())], ["lang", "piece", "n"])

    return in_small_batches(docs).mapInArrow(run, "lang string, piece string, n long")


def fit(docs: DataFrame, path: str, per_language: int = 1000, smoothing: float = 0.5, text: str = "text", lang: str = "lang",
        doc_id: str = "doc_id") -> Model:
    """Learns from at most ``per_language`` texts of each language, drawn by a hash of the id; the shares of the languages come
    from all rows."""
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"))
    shares = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(shares)
    # hashes are even, so the lowest ``4 * per_language / n`` of them hold the draw; only those meet in a window
    place, limit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)), F.lit(0)
    for name, n in shares.items():
        limit = F.when(F.col("lang") == name, F.lit(int((1 << 40) * min(1.0, 4 * per_language / n)))).otherwise(limit)
    w = Window.partitionBy("lang").orderBy("place", "doc_id")
    drawn = rows.select("doc_id", "lang", place.alias("place")).where(F.col("place") < limit)
    drawn = drawn.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_language)
    drawn = drawn.select("doc_id", "lang").distinct()
    if len(languages) * per_language <= 1_000_000:
        drawn = F.broadcast(drawn)  # at most that many rows of an id and a name
    sample = settle(rows.join(drawn, ["doc_id", "lang"], "left_semi").select("lang", "text"))  # read twice, few of all texts
    pieces = {p: i for i, p in enumerate(vocabulary(path))}
    counts = np.full((len(pieces) + 1, len(languages)), smoothing)
    column = {name: i for i, name in enumerate(languages)}
    for r in _count_pieces(sample, path).groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect():  # vocabulary x languages
        counts[pieces.get(r["piece"], len(pieces)), column[r["lang"]]] += r["n"]
    total = sum(shares.values())
    prior = np.log(np.array([shares[x] / total for x in languages])) if languages else np.zeros(0)
    model = Model(languages, prior, pieces, counts / counts.sum(0) if languages else counts)
    model.usual = _usual(sample, model)
    return model


def _usual(sample: DataFrame, model: Model) -> np.ndarray:
    """``Model.usual`` from the texts of the sample: sums a text, written once, and two sums over them a language."""
    column = {name: i for i, name in enumerate(model.languages)}
    shared = sample.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages
    names = ["s", "n", "ss", "sn", "nn"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in strips(batch, 1):
                texts = [parts(t) for t in part.column(1).to_pylist()]
                words = list({w for ws in texts for w in ws})
                score = dict(zip(words, known.word_scores(words)))
                rows = []
                for lang, ws in zip(part.column(0).to_pylist(), texts):
                    if ws:
                        s = np.array([score[w][column[lang]] for w in ws])
                        n = np.array(list(map(len, ws)), float)
                        rows.append((column[lang], s.sum(), n.sum(), s @ s, s @ n, n @ n))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", *names])

    texts = settle(in_small_batches(sample).mapInArrow(run, "lang long, " + ", ".join(f"{n} double" for n in names)))
    out = np.zeros((len(column), 4))
    out[:, 3] = 1.0
    sums = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("squares"), *[F.sum(n).alias(n) for n in names])
    for r in sums.collect():  # a row a language
        mu = r["s"] / r["n"]
        within = max(0.0, (r["ss"] - 2 * mu * r["sn"] + mu * mu * r["nn"]) / r["n"])
        out[r["lang"], :3] = mu, max(0.0, r["squares"] / r["n"] - mu * mu - within * r["texts"] / r["n"]), within
    far = F.lit(None).cast("double")
    for i, (mu, between, within, _) in enumerate(out.tolist()):
        far = F.when(F.col("lang") == i, (mu - F.col("s") / F.col("n")) / F.greatest(F.sqrt(between + within / F.col("n")), F.lit(1e-9))).otherwise(far)
    for r in texts.groupBy("lang").agg(F.max(far).alias("most")).collect():
        out[r["lang"], 3] = max(1.0, r["most"])
    return out


class _Texts:
    """Summed scores of the words of texts, kept by word; the last column counts letters."""

    def __init__(self, model: Model, most: int = 300_000) -> None:
        self.model = model
        self.rows = np.zeros((0, len(model.languages) + 1))
        self.used = 0
        self.memo = Memo(self._solve, most)

    def _solve(self, words: list[str]) -> range:
        if not self.memo.known:
            self.used = 0
        if self.used + len(words) > len(self.rows):
            more = np.zeros((max(65_536, 2 * len(self.rows), self.used + len(words)), self.rows.shape[1]))
            more[:self.used] = self.rows[:self.used]
            self.rows = more
        new = range(self.used, self.used + len(words))
        self.rows[new, :-1] = self.model.word_scores(words)
        self.rows[new, -1] = list(map(len, words))
        self.used += len(words)
        return new

    def __call__(self, texts: list) -> list:
        cut = [parts((t or b"").decode("utf-8", "replace")) for t in texts]
        self.memo.know(set().union(*cut))
        names, scores, surprises = [], [], []
        for ws in cut:
            total = self.rows[list(map(self.memo.known.__getitem__, ws))].sum(0) if ws else self.rows[:0].sum(0)
            if not self.model.languages or total[-1] == 0:
                names.append(UND)
                scores.append(0.0)
                surprises.append(None)
                continue
            log = total[:-1] + self.model.prior
            best = int(log.argmax())
            names.append(self.model.languages[best])
            scores.append(float(1 / np.exp(log - log[best]).sum()))
            mu, between, within, most = self.model.usual[best]
            surprises.append(float((mu - total[best] / total[-1]) / max(math.sqrt(between + within / total[-1]), 1e-9) / most))
        return [names, scores, surprises]


def identify(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """Adds the best language, its posterior and, under a third of the ``names``, the surprise (null for ``und``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages
    fields = ", ".join(f"`{n}` {t}" for n, t in zip(names, ("string", "double", "double")))

    def make():
        told = _Texts(shared.value)
        return lambda texts: told(texts)[:len(names)]

    return with_columns(docs, [text], make, fields)
