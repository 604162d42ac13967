"""Toxicity by a weighted lexicon.

Texts are folded (case, homoglyphs, digits and signs that stand for letters,
zero-width characters), and an Aho-Corasick automaton finds lexicon words,
lexicon stems (beginnings of words) and exception phrases in one walk. Hits
inside an exception don't count. The weights of the hits, their density by length
and a constant go into a logistic function.

The lexicon starts from a fixed list and is extended from labelled rows: words
and stems that toxic texts have far more often than others, by a likelihood-ratio
test over document counts, and phrases that turn a hit into a harmless one. At
most ``max_labelled`` labelled rows are used, those with the smallest hash of
their id; copies and near copies among them (equal sketches) count once. Only
text is an input of a score.

Defined results: null and empty texts get the score of a text without hits; a
table without labels leaves the fixed list with its fixed weights; an empty table
gives no rows; repeated rows get the same score; a doc_id that is null or has no
label is scored but never learned from; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, giving_back, text_or_empty

#: A small lexicon of insults, phrases that are harmless though they hold one, and look-alike characters.
INSULTS = (
    "idiot idiots idiotic moron morons moronic stupid scum trash pathetic worthless loser losers clown disgusting dumb dumbass imbecile bastard bitch "
    "asshole arsehole jerk cretin vermin filth scumbag dipshit fuck fucking fucker shit shitty slut whore retard retarded twat wanker prick bollocks"
).split()
EXCEPTIONS = ["trash can", "trash bin", "trash collection", "clown fish", "circus clown", "idiot proof", "stupid question", "dumb waiter", "sore loser board", "knee jerk", "jerk chicken"]
LOOK_ALIKE = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "ι": "i", "κ": "k", "ν": "v", "χ": "x", "η": "n", "ı": "i", "ł": "l", "ø": "o",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "i", "€": "e"}
STEM_LENGTHS = (4, 5, 6, 7)
PRIOR_WEIGHT = 4.0


def fold_table() -> dict[int, str | None]:
    """For str.translate: letters to themselves, what stands for a letter to it, all else to a space."""
    table: dict[int, str | None] = {c: " " for c in range(128) if not chr(c).isalpha()}
    table |= {ord(k): v for k, v in (LOOK_ALIKE | DIGITS).items()}
    table |= {c: chr(c - 0xFEE0).lower() if chr(c - 0xFEE0).isalpha() else DIGITS.get(chr(c - 0xFEE0), " ") for c in range(0xFF01, 0xFF5F)}
    table |= dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
    table |= dict.fromkeys([0xA0, 0xA1, 0xAB, 0xBB, 0xBF, *range(0x2000, 0x200B), *range(0x2010, 0x2030), 0x3000], " ")
    return table


FOLD = fold_table()
SIGN = re.compile(r"[@$!|€](?=[^\W_])")


def fold(text: str) -> str:
    """Lower-case letters with one or more spaces between words, and a space at both ends."""
    text = text.lower()
    if SIGN.search(text):
        text = SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {text.translate(FOLD)} "


class Lexicon:
    """weights: pattern to weight; a pattern is `` word `` or `` stem``. exceptions: folded phrases."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], coefficients: tuple[float, float, float] = (-4.0, 2.0, 0.5)) -> None:
        self.weights, self.exceptions, self.coefficients = weights, exceptions, coefficients

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        for pattern, weight in self.weights.items():
            found.add_word(pattern, (len(pattern), weight))
        found.make_automaton()
        return found

    def features(self, automaton, folded: str) -> tuple[float, float]:
        """Log of the summed weights, and log of the weights by hundred words."""
        hits = list(automaton.iter(folded)) if len(automaton) else []
        if not hits:
            return 0.0, 0.0
        spans = [(end - size + 1, end) for end, (size, weight) in hits if weight is None]
        taken: dict[int, float] = {}  # one hit a word, the heaviest
        for end, (size, weight) in hits:
            start = end - size + 1
            if weight is not None and not any(a <= start and end <= b for a, b in spans):
                taken[start] = max(weight, taken.get(start, 0.0))
        total = sum(taken.values())
        words = len(folded.split())
        return math.log1p(total), math.log1p(100 * total / max(words, 20))

    def score(self, features: np.ndarray) -> np.ndarray:
        c = self.coefficients
        return 1 / (1 + np.exp(-(c[0] + features @ np.array(c[1:]))))


def bucket_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 5


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(words array, text, toxic) of the labelled rows to learn from."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (bucket_of(F.col("doc_id")) != 0))
    per_id = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = per_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)  # at most max_labelled rows of two numbers, so it may be broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            folded = [fold(t) for t in batch.column("text").to_pylist()]
            words = [sorted(set(t.split())) for t in folded]
            sketch = [" ".join(str(min((xxh64_intdigest(w, seed) for w in ws), default=0)) for seed in (1, 2, 3)) for ws in words]
            yield pa.RecordBatch.from_arrays([pa.array(folded), pa.array(words, pa.list_(pa.string())), batch.column("toxic"), pa.array(sketch)], names=["folded", "words", "toxic", "sketch"])

    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))
    return rows.mapInArrow(giving_back(run), "folded string, words array<string>, toxic int, sketch string").dropDuplicates(["sketch", "toxic"])


def ratio_test(pos: Column, neg: Column, n_pos: int, n_neg: int) -> Column:
    """Twice the log-likelihood ratio that a feature's document counts differ by label."""
    share = F.lit(n_pos / (n_pos + n_neg))

    def term(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    both = pos + neg
    return 2 * (term(pos, both * share) + term(neg, both * (1 - share)))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 12_000, least_ratio: float = 24.0, least_precision: float = 0.9) -> Lexicon:
    """A lexicon and the logistic function's coefficients, from at most ``max_labelled`` labelled rows."""
    rows = cut(training_rows(docs, labels, max_labelled))
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    base = {f" {w} ": PRIOR_WEIGHT for w in INSULTS}
    plain = Lexicon(base, [f" {p} " for p in EXCEPTIONS])
    if not n_pos or not n_neg:
        return plain

    words = cut(rows.select(F.explode("words").alias("word"), "toxic").groupBy("word").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")))
    strong = (ratio_test(F.col("pos"), F.col("neg"), n_pos, n_neg) >= least_ratio) & (F.col("pos") >= least_precision * (F.col("pos") + F.col("neg")))
    whole = words.where((F.length("word") > 2) & strong).select("word", "pos", "neg", F.lit(1).alias("n_words"), F.col("pos").alias("most"))
    cuts = F.explode(F.array(*[F.lit(k) for k in STEM_LENGTHS])).alias("k")
    stems = words.select("word", "pos", "neg", cuts).where(F.length("word") > F.col("k")).groupBy(F.expr("substring(word, 1, k)").alias("word")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.count(F.lit(1)).alias("n_words"), F.max("pos").alias("most"))
    varied = stems.where(strong & (F.col("n_words") >= 4) & (F.col("most") <= 0.6 * F.col("pos")))
    doubtful = words.where(F.col("word").isin(INSULTS)).collect()  # as many rows as the fixed list at most

    weights = dict(base)
    for r in doubtful:
        weights[f" {r['word']} "] = max(0.0, weight_of(r["pos"], r["neg"], n_pos, n_neg, PRIOR_WEIGHT))
    accepted: list[str] = []
    for r in sorted(varied.toLocalIterator(), key=lambda r: (len(r["word"]), r["word"])):
        if not any(r["word"].startswith(s) for s in accepted):
            accepted.append(r["word"])
            weights[f" {r['word']}"] = weight_of(r["pos"], r["neg"], n_pos, n_neg)
    for r in whole.toLocalIterator():
        if not any(r["word"].startswith(s) for s in accepted):
            weights[f" {r['word']} "] = weight_of(r["pos"], r["neg"], n_pos, n_neg)
    found = Lexicon({k: w for k, w in weights.items() if w > 0}, plain.exceptions + harmless_phrases(rows, weights))
    found.coefficients = fit(rows, found)
    return found


def weight_of(pos: float, neg: float, n_pos: int, n_neg: int, prior: float | None = None) -> float:
    """Smoothed log odds; a prior weight counts as some five documents."""
    found = math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))
    if prior is None:
        return found
    seen = pos + neg
    return (found * seen + prior * 5) / (seen + 5)


def harmless_phrases(rows: DataFrame, weights: dict[str, float], least: int = 3) -> list[str]:
    """Pairs of words around a lexicon word that only texts without the label have."""
    known = {p.strip() for p in weights if p.endswith(" ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = []
            for text in batch.column("folded").to_pylist():
                words = text.split()
                pairs.append(sorted({f" {a} {b} " for a, b in zip(words, words[1:], strict=False) if a in known or b in known}))
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.list_(pa.string())), batch.column("toxic")], names=["pairs", "toxic"])

    seen = rows.select("folded", "toxic").mapInArrow(giving_back(run), "pairs array<string>, toxic int").select(F.explode("pairs").alias("pair"), "toxic")
    kept = seen.groupBy("pair").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).where((F.col("pos") == 0) & (F.col("neg") >= least))
    return sorted(r["pair"] for r in kept.toLocalIterator())


def fit(rows: DataFrame, lexicon: Lexicon, ridge: float = 0.05, steps: int = 25) -> tuple[float, float, float]:
    """Coefficients by Newton's method on the rows' features (at most ``max_labelled`` rows of two numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            a, b = zip(*[lexicon.features(automaton, t) for t in batch.column("folded").to_pylist()], strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.float64()), pa.array(b, pa.float64()), batch.column("toxic")], names=["a", "b", "toxic"])

    got = rows.select("folded", "toxic").mapInArrow(giving_back(run), "a double, b double, toxic int").toArrow()
    x = np.column_stack([np.ones(got.num_rows), got.column("a").to_numpy(), got.column("b").to_numpy()])
    y, w = got.column("toxic").to_numpy().astype(float), np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = ridge * np.array([0.01, 1.0, 1.0])
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
    return float(w[0]), float(w[1]), float(w[2])


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``; the lexicon's size follows from its bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            features = np.array([lexicon.features(automaton, fold(t)) for t in batch.column("text").to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lexicon.score(features))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(giving_back(run), f"doc_id {kind}, score double")
    held = F.coalesce(bucket_of(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows predicted toxic: each row is judged by its own text, whatever its doc_id."""
    lexicon = learn(docs, labels)

    @F.arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton = lexicon.automaton()
        for batch in texts:
            features = np.array([lexicon.features(automaton, fold(t)) for t in batch.to_pylist()]).reshape(-1, 2)
            yield pa.array(lexicon.score(features) < 0.5)

    return docs.where(clean(text_or_empty()))
