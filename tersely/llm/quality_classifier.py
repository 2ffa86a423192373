"""Quality classifier: a weak-label model, whose posterior labels train a hashed linear scorer.

Heuristic labellers vote good, bad or nothing on each document, on two questions: is it fit to read (capitals, symbols,
repetition, exclamation marks, word lengths), and is it free of abuse (terms that labelled documents tie to abuse). The given
labels are one more labeller of each. Votes overlap; expectation-maximisation over the counts of vote patterns (of all
documents; the number of patterns is bounded, whatever the input) estimates each labeller's accuracy and each
pattern's posterior. The product of the two posteriors is the target of a logistic scorer with an L1 penalty over hashed words,
words' prefixes (so a stem counts whatever its endings), prefixes that are found twice or more, and figures. The scorer is fitted
on at most SAMPLE labelled documents (those of least hash), and scores every document.

Null and empty texts have no words and are scored by their figures alone. Labels that repeat count by their worst; labels
with a null doc_id or null marks are left out; without labels of documents at hand the least hashes among all documents are the
sample. Where no document has an id there is nothing to learn from: scores are null and all documents are kept. A null
doc_id is carried along, repeated rows get equal results, an empty table gives an empty one; other columns are left alone.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tersely.llm.common import id_text, keyed, pieces

#: Labelled documents that fit the scorer and the terms, at most.
SAMPLE = 6000
BITS = 20
#: Characters of the prefixes that are hashed beside whole words.
PREFIXES = (4, 5, 6)
#: A term is tied to abuse if so many sampled abusive documents hold it, and they are so large a part of all that do.
TERM_DOCUMENTS, TERM_PRECISION = 4, 0.75
PENALTY, ROUNDS = 5e-5, 400
#: Features that fewer sampled documents hold have no weight.
FEATURE_DOCUMENTS = 4
MEMO_ENTRIES, STEM_ENTRIES = 500_000, 100_000
#: Entries of the sample that are summed at once.
BLOCK = 1 << 16
#: Turns a word's or prefix's feature into that of its being found twice or more.
TWICE = 0x9E375
STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_"
SYMBOL = np.zeros(128, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>^~=+@\\/{}[]_`"]] = True
FIGURES = ("capitals", "symbols", "variety", "exclaimed", "length")
#: Of each figure: the value from which (or below which) a labeller says bad, and the one from which it says good.
VOTES = {"capitals": (0.4, 0.15), "symbols": (0.5, 0.1), "variety": (0.2, 0.35), "exclaimed": (0.3, 0.05), "length": (14.0, 9.0)}


def feature(name: str) -> int:
    return xxhash.xxh32_intdigest(name) & ((1 << BITS) - 1)


class Reader:
    """Turns texts into figures and hashed words and prefixes; words' hashes are kept in a bounded memo.

    Where `wanted` features are given, the others that a text has may be left out, and words that have none are set aside as idle."""

    def __init__(self, wanted: frozenset | None = None):
        self.wanted = None if wanted is None else wanted | {f ^ TWICE for f in wanted}
        self.memo: dict[str, tuple[int, ...]] = {}
        self.idle: set[str] = set()
        self.stems: dict[str, tuple[int, ...]] = {}

    def stem(self, stem: str) -> tuple[int, ...]:
        """Features of the prefixes of all words that begin so."""
        if (f := self.stems.get(stem)) is None:
            if len(self.stems) >= STEM_ENTRIES:
                self.stems.clear()
            f = tuple(feature(f"\x01{stem[:n]}") for n in PREFIXES if len(stem) >= n)
            if self.wanted is not None:
                f = tuple(x for x in f if x in self.wanted)
            self.stems[stem] = f
        return f

    def word(self, word: str) -> tuple[int, ...]:
        """Features of a word: its own, then those of its prefixes."""
        if (f := self.memo.get(word)) is None:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            bare = word.strip(STRIP) or word
            f, own = self.stem(bare[: PREFIXES[-1]]), feature(bare)
            if self.wanted is None or own in self.wanted:
                f = (own, *f)
            if len(word) <= 64 and f:
                self.memo[word] = f
            elif len(word) <= 64:
                if len(self.idle) >= MEMO_ENTRIES:
                    self.idle.clear()
                self.idle.add(word)
        return f

    def read(self, text: str) -> tuple[list[float], set[int]]:
        lower = text.lower()
        found = lower.split()
        words = Counter(found)
        n = len(found)
        code, width = ("ascii", np.uint8) if text.isascii() else ("utf-32-le", np.uint32)
        points = np.frombuffer(text.encode(code), dtype=width)
        changed = np.frombuffer(lower.encode(code), dtype=width)
        capitals = int((points != changed).sum()) if len(points) == len(changed) else sum(map(str.isupper, text))
        ink = max(1, sum(map(len, found)))
        symbols = int(SYMBOL[points[points < 128]].sum())
        variety = min(1.0, len(words) / (4 * math.sqrt(n))) if n >= 20 else 1.0
        figures = [capitals / ink, symbols / max(1, n), variety, text.count("!") / max(1, n), ink / max(1, n)]
        count: dict[int, int] = {}
        memo = self.memo
        for word in words.keys() - self.idle:
            features, c = memo.get(word), words[word]
            for f in self.word(word) if features is None else features:
                count[f] = count.get(f, 0) + c
        return figures, count.keys() | {f ^ TWICE for f, c in count.items() if c > 1}


def shape(figures: list[float]) -> list[int]:
    """Features of figures: their votes, and their values in steps."""
    votes = [feature(f"\x00{name}={v}") for name, v in zip(FIGURES, vote(figures), strict=True)]
    return votes + [feature(f"\x00{name}:{min(12, int(value * (1 if name == 'length' else 10)))}") for name, value in zip(FIGURES, figures, strict=True)]


def vote(figures: list[float]) -> list[int]:
    """1 good, 0 bad, -1 nothing, by each figure."""
    out = []
    for name, value in zip(FIGURES, figures, strict=True):
        bad, good = VOTES[name]
        out.append((0 if value >= bad else 1 if value < good else -1) if bad > good else (0 if value < bad else 1 if value >= good else -1))
    return out


@dataclass
class LabelModel:
    """Prior and vote probabilities of two classes: `table[class, labeller, vote + 1]`."""

    prior: np.ndarray
    table: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Of good, for each row of votes."""
        log = np.log(self.prior)[None, :] + np.log(self.table[:, np.arange(votes.shape[1])[None, :], votes + 1]).sum(axis=2).T
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))

    def accuracy(self) -> np.ndarray:
        """Of each labeller, where it votes."""
        right = self.prior[0] * self.table[0, :, 1] + self.prior[1] * self.table[1, :, 2]
        return right / (right + self.prior[0] * self.table[0, :, 2] + self.prior[1] * self.table[1, :, 1])


def expectation_maximisation(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """From vote patterns and their counts; starts from the share of good among each pattern's votes, the last labeller
    (given labels) counting as five."""
    weight = np.ones(votes.shape[1])
    weight[-1] = 5
    good, cast = ((votes == 1) * weight).sum(axis=1), ((votes >= 0) * weight).sum(axis=1)
    q = np.where(cast > 0, np.clip(good / np.maximum(cast, 1), 0.01, 0.99), 0.9)
    for _ in range(rounds):
        mass = np.stack((counts * (1 - q), counts * q))
        prior = (mass.sum(axis=1) + 1) / (counts.sum() + 2)
        table = np.stack([np.stack([(mass[c][:, None] * (votes == v)).sum(axis=0) for v in (-1, 0, 1)], axis=1) for c in (0, 1)]) + 0.1
        model = LabelModel(prior, table / table.sum(axis=2, keepdims=True))
        q = model.posterior(votes)
    return model


class Groups:
    """Indices in consecutive groups, none of them empty; sums of values by group look up a block of entries at a time."""

    def __init__(self, index: np.ndarray, sizes: np.ndarray):
        self.index = index
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        self.blocks: list[tuple[int, int, int, int]] = []
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, self.starts[first] + BLOCK, "right")))
            self.blocks.append((first, last, int(self.starts[first]), int(ends[last - 1])))
            first = last

    def sums(self, values: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.starts))
        for first, last, start, end in self.blocks:
            out[first:last] = np.add.reduceat(values[self.index[start:end]], self.starts[first:last] - start)
        return out


def holders(rows: list[np.ndarray]) -> np.ndarray:
    """Of each feature, how many rows (of distinct features) hold it."""
    out = np.zeros(1 << BITS, dtype=np.int64)
    for r in rows:
        out[r] += 1
    return out


def fit(rows: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """Weights of 2**BITS features and, last, the bias: logistic loss with an L1 penalty, by accelerated proximal steps.

    Rows hold distinct features. The driver has little memory beside its JVM, so the sample is kept twice only (features by row, rows
    by feature), in the smallest numbers, and all else in blocks."""
    held = holders(rows)
    present = np.flatnonzero(held)
    held, size, n = held[present], len(present), len(rows)
    place = np.zeros(1 << BITS, dtype=np.int32)
    place[present] = np.arange(size)
    lengths = np.array([len(r) for r in rows])
    index, holding = np.empty(lengths.sum(), dtype=np.int32), np.empty(lengths.sum(), dtype=np.min_scalar_type(n))
    done, free = 0, np.cumsum(held) - held
    for k, r in enumerate(rows):
        index[done : done + len(r)] = own = place[r]
        holding[free[own]] = k
        free[own] += 1
        done += len(r)
    some = np.flatnonzero(lengths)
    by_row, by_feature = Groups(index, lengths[some]), Groups(holding, held)

    def row_sums(values: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        out[some] = by_row.sums(values)
        return out

    share = min(max(float(target.mean()), 0.01), 0.99)
    weight = target / (2 * share) + (1 - target) / (2 * (1 - share))  # both classes count alike
    # A step for each feature, by a bound on the loss that holds for any speeds: features that tell the classes apart go fastest.
    told = np.abs(by_feature.sums(weight * (share - target))) / np.sqrt(held)
    speed = np.maximum(told, 0.01 * told.max()) if told.any() else np.ones(size)
    fastest = speed.max(initial=1e-9)
    load = weight * (row_sums(speed) + fastest)
    rate = 4 * n * speed / by_feature.sums(load)
    bias_rate = 4 * n * fastest / load.sum()
    w, before, bias, bias_before, t = np.zeros(size), np.zeros(size), 0.0, 0.0, 1.0
    for _ in range(ROUNDS):
        following = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead, bias_ahead = w + (t - 1) / following * (w - before), bias + (t - 1) / following * (bias - bias_before)
        z = row_sums(ahead) + bias_ahead
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target)
        step = ahead - rate * by_feature.sums(error) / n
        before, w = w, np.sign(step) * np.maximum(np.abs(step) - rate * PENALTY, 0)
        bias_before, bias, t = bias, bias_ahead - bias_rate * error.mean(), following
    out = np.zeros((1 << BITS) + 1)
    out[present], out[-1] = w, bias
    return out


@dataclass
class Classifier:
    """Terms, both label models and the scorer's weights."""

    terms: frozenset
    quality: LabelModel
    abuse: LabelModel
    weights: dict[int, float]
    bias: float

    def score(self, figures: list[float], words: set[int]) -> float:
        weights = self.weights
        z = self.bias + math.fsum(weights[f] for f in weights.keys() & words) + sum(weights.get(f, 0.0) for f in shape(figures))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def abusive_terms(held: np.ndarray, abusive: np.ndarray, share: float) -> frozenset:
    """Features that so many abusive documents hold, out of all that hold them, that of all features less than one is expected to by
    chance (Chernoff's bound), where `share` of the documents are abusive."""
    some = np.flatnonzero((abusive >= TERM_DOCUMENTS) & (abusive >= TERM_PRECISION * held) & (abusive > share * held))
    p = abusive[some] / held[some]
    surprise = held[some] * (p * np.log(p / share) + (1 - p) * np.log(np.maximum(1 - p, 1e-12) / (1 - share)))
    return frozenset(some[surprise >= np.log(max(1, (held >= TERM_DOCUMENTS).sum()))].tolist())


def given_labels(labels: DataFrame) -> DataFrame:
    """`label_id, quality, toxic`: one row a document."""
    rows = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    return rows.dropna().groupBy("label_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Classifier | None:
    """A classifier, or None where there are no documents."""
    texts = keyed(docs, id_col, text_col)
    known = given_labels(labels)

    def least(ids: DataFrame) -> DataFrame:
        return ids.orderBy(F.xxhash64("id"), "id").limit(sample)

    def features(batches):
        reader = Reader()
        for batch in (x for b in batches for x in pieces(b, "text")):
            read = [reader.read(t) for t in batch.column("text").to_pylist()]
            words = [np.array(sorted({*f, *shape(g)}), dtype=np.int32).tobytes() for g, f in read]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g for g, _ in read], pa.list_(pa.float64())), pa.array(words, pa.binary())], names=["doc_id", "figures", "words"])

    def sampled(ids: DataFrame) -> list:
        # The sample's size is a parameter, so broadcasting its ids is bounded, and so are the rows: of rows that share an id, those of least hash.
        picked = texts.select("doc_id", "rk").join(F.broadcast(ids), F.col("doc_id") == F.col("id")).select(F.col("doc_id").alias("id"), F.col("rk").alias("key")).distinct()
        picked = F.broadcast(picked.orderBy(F.xxhash64("id"), "id", "key").limit(sample))
        rows = texts.join(picked, (F.col("doc_id") == F.col("id")) & (F.col("rk") == F.col("key"))).select("doc_id", "rk", "text").groupBy("doc_id", "rk").agg(F.first("text").alias("text")).select("doc_id", "text")
        rows = rows.mapInArrow(features, "doc_id long, figures array<double>, words binary")
        return rows.join(F.broadcast(known.join(F.broadcast(ids), F.col("label_id") == F.col("id"), "left_semi")), F.col("doc_id") == F.col("label_id"), "left").collect()

    rows = sampled(least(known.select(F.col("label_id").alias("id")).join(texts.select(F.col("doc_id").alias("id")), "id", "left_semi"))) or sampled(least(texts.filter("doc_id is not null").select(F.col("doc_id").alias("id")).distinct()))
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.words))
    words = [np.frombuffer(r.words, dtype=np.int32) for r in rows]
    rows = [(r.figures, r.quality, r.toxic) for r in rows]
    toxic = np.array([t == 1 for _, _, t in rows])
    held, abusive = holders(words), holders([w for w, t in zip(words, toxic, strict=True) if t])
    terms = abusive_terms(held, abusive, toxic.mean())

    def patterns(batches):
        reader = Reader(terms)
        for batch in (x for b in batches for x in pieces(b, "text")):
            code = []
            for text in batch.column("text").to_pylist():
                figures, found = reader.read(text)
                code.append(pattern([*vote(figures), 0 if found & terms else 1]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(code, pa.int32())], names=["doc_id", "votes"])

    voted = texts.select("doc_id", "text").mapInArrow(patterns, "doc_id long, votes int").join(known, F.col("doc_id") == F.col("label_id"), "left")
    counted = [(list(unpattern(r.votes)), r.quality, r.toxic, r.n) for r in voted.groupBy("votes", "quality", "toxic").agg(F.count("*").alias("n")).collect()]
    counts = np.array([c[3] for c in counted], dtype=float)
    quality = expectation_maximisation(np.array([[*v[:-1], -1 if q is None else int(q > 0)] for v, q, _, _ in counted]), counts)
    abuse = expectation_maximisation(np.array([[v[-1], -1 if t is None else int(t == 0)] for v, _, t, _ in counted]), counts)
    good = quality.posterior(np.array([[*vote(figures), -1 if q is None else int(q > 0)] for figures, q, _ in rows]))
    clean = abuse.posterior(np.array([[int(not terms.intersection(w.tolist())), -1 if t is None else int(t == 0)] for w, (_, _, t) in zip(words, rows, strict=True)]))
    common = held >= FEATURE_DOCUMENTS
    for k, x in enumerate(words):  # each goes as it is replaced
        words[k] = x[common[x]]
    w = fit(words, good * clean)
    return Classifier(terms, quality, abuse, {int(i): float(w[i]) for i in np.flatnonzero(w[:-1])}, float(w[-1]))


def pattern(votes: list[int]) -> int:
    """Votes as one number, in base 3."""
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    return code


def unpattern(code: int) -> tuple[int, ...]:
    out = []
    for _ in range(len(FIGURES) + 1):
        code, v = divmod(code, 3)
        out.append(v - 1)
    return tuple(reversed(out))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.35, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: `doc_id, score` (of good), `kept` (score of `threshold` or more). Training jobs run at once."""
    model = train(docs, labels, sample, id_col, text_col)
    return id_text(docs, id_col, text_col).mapInArrow(scored(model, threshold), "doc_id long, score double, kept boolean")


def scored(model: Classifier | None, threshold: float):
    def step(batches):
        reader = Reader(frozenset(model.weights)) if model else None
        for batch in (x for b in batches for x in pieces(b, "text")):
            scores = [round(model.score(*reader.read(t)), 6) if model else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([s is None or s >= threshold for s in scores], pa.bool_())], names=["doc_id", "score", "kept"])

    return step


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.35, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table without the documents that the classifier rejects; no shuffle of texts."""
    model = train(docs, labels, sample, id_col, text_col)

    def step(batches):
        reader = Reader(frozenset(model.weights))
        for batch in (x for b in batches for x in pieces(b, text_col)):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([model.score(*reader.read(t or "")) >= threshold for t in texts], pa.bool_()))

    return docs.mapInArrow(step, docs.schema) if model else docs
