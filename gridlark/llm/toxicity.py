"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .boosting import Boosted
from .common import fresh, mapped, read_table, text_or_empty, written

#: Rows with this remainder of crc32(doc_id as text) mod 4 are held out; those with CALIBRATE fit the calibration only.
HELD_OUT, CALIBRATE = 2, 3
#: The classifier is fitted on about this many labelled rows, picked by a hash of doc_id (all, if there are fewer).
SAMPLE = 24_000
#: Lexicon entries that fit() learns by default, the strongest first: like SAMPLE a bound of the model, a parameter of it.
ENTRIES = 4_000
#: A lexicon entry's odds against clean rows and its toxic rows, at least. Its likelihood-ratio statistic (G squared)
#: must reach 2 ln(m), where m entries have that many rows: about one of them would by chance.
ODDS, ROWS = 8.0, 4
THRESHOLD = 0.3

#: Words that insult in any context, and words that address the reader.
INSULTS = frozenset("idiot idiots moron morons loser losers scum trash garbage stupid dumb pathetic worthless disgusting clown clowns imbecile cretin vermin parasite filth scumbag dumbass jerk creep lowlife degenerate".split())
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre usted ustedes vosotros ti contigo".split())
LEET = str.maketrans("013457@$!|", "oieastasii")
EDGE = "\"'.,;:!?()[]{}<>|*#%&$-_`´’“”«»…"
PREFIXES = (4, 5, 6, 7, 8)
#: Tokens whose lexicon weight a worker remembers.
REMEMBER = 200_000

NAMES = ("words", "learned", "learned_density", "learned_max", "learned_sum", "insults", "insult_density", "near_you", "near_you_density", "second_person", "capitals", "shouted", "exclaims", "questions", "punctuation", "runs", "obfuscated", "obfuscated_insults", "mixed", "distinct")


def plain(token: str) -> str:
    return token.strip(EDGE)


def unmasked(token: str) -> str:
    """The token with look-alike digits and signs as letters, separators out and long repeats shortened."""
    t = re.sub(r"[^a-zà-ÿß]", "", token.translate(LEET))
    return re.sub(r"(.)\1{2,}", r"\1", t)


def grams(token: str) -> list[str]:
    """Lexicon entries a token can match: itself, and its beginnings (inflections share them)."""
    return [f"={token}", *(f"{n}{token[:n]}" for n in PREFIXES if len(token) >= n)]


WORDS, MARKS, CAPITALS = re.compile(r"[^\W\d_]+"), re.compile(r"[^\w\s]"), re.compile(r"[A-ZÀ-Þ]")
SHOUTED, RUNS, REPEATED = re.compile(r"\b[A-ZÀ-Þ]{3,}\b"), re.compile(r"([!?*.$#%&])\1+"), re.compile(r"(.)\1\1")


class Features:
    """Turns texts into rows of NAMES, given the learned lexicon (entry to weight).

    A worker remembers each token: 0 if it says nothing, or else what it is: (learned weight, insult, masked insult,
    second person, letters mixed with digits)."""

    def __init__(self, lexicon: dict[str, float]):
        self.whole = {e[1:]: w for e, w in lexicon.items() if e[0] == "="}
        self.starts = [(n, {e[1:]: w for e, w in lexicon.items() if e[0] == str(n)}) for n in PREFIXES]
        self.known: dict[str, tuple[float, bool, bool, bool, bool] | int] = {}

    def look_up(self, token: str) -> tuple[float, bool, bool, bool, bool] | int:
        p = plain(token)
        if not p:
            return 0
        w = self.whole.get(p, 0.0)
        for n, entries in self.starts:
            if len(p) >= n and (v := entries.get(p[:n], 0.0)) > w:
                w = v
        insult, masked, alpha = p in INSULTS, False, p.isalpha()
        if not insult and (not alpha or REPEATED.search(p)):
            u = unmasked(p)
            masked = len(u) >= 4 and u != p and (u in INSULTS or not alpha and u in self.whole)
        mixed = not token.isalpha() and any(c.isdigit() for c in token) and any(c.isalpha() for c in token)
        you = p in SECOND_PERSON
        return (w, insult or masked, masked, you, mixed and not you) if w or insult or masked or you or mixed else 0

    def row(self, text: str) -> list[float]:
        low = text.lower().split()
        counts, known = Counter(low), self.known
        n = len(low) or 1
        hits: dict[str, tuple[float, bool, bool, bool, bool]] = {}
        ours: set[str] = set()
        mixed = 0
        for t, k in counts.items():
            found = known.get(t)
            if found is None:
                if len(known) >= REMEMBER:
                    known.clear()
                found = known[t] = self.look_up(t)
            if found:
                if found[0] or found[1]:
                    hits[t] = found
                if found[3]:
                    ours.add(t)
                mixed += k * found[4]
        learned = sum(counts[t] for t, x in hits.items() if x[0])
        insults = sum(counts[t] for t, x in hits.items() if x[1])
        masked = sum(counts[t] for t, x in hits.items() if x[2])
        you = sum(counts[t] for t in ours)
        near = 0
        if hits and ours:
            at = {i for i, t in enumerate(low) if t in hits}
            near = sum(any(j in at for j in range(i - 4, i + 5)) for i, t in enumerate(low) if t in ours)
        letters = sum(map(len, WORDS.findall(text)))
        return [
            np.log1p(len(low)), learned, 100 * learned / n, max((x[0] for x in hits.values()), default=0.0), sum(x[0] * counts[t] for t, x in hits.items()),
            insults, 100 * insults / n, near, 100 * near / n, 100 * you / n,
            len(CAPITALS.findall(text)) / (letters or 1), len(SHOUTED.findall(text)) / n, 100 * text.count("!") / n, 100 * text.count("?") / n, len(MARKS.findall(text)) / (len(text) or 1), 100 * len(RUNS.findall(text)) / n,
            100 * masked / n, masked, 100 * mixed / n, len(counts) / n,
        ]

    def matrix(self, texts: list[str]) -> np.ndarray:
        return np.array([self.row(t) for t in texts], float).reshape(-1, len(NAMES))


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: Boosted


def remainder(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4, F.lit(0))


def learn_lexicon(sample: DataFrame, entries: int = ENTRIES) -> dict[str, float]:
    """The strongest `entries` over-represented in toxic rows of the sample (text, toxic), with their log odds. Rows are
    counted once an entry, on the executors; only these come to the driver."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            toxic, clean = Counter(), Counter()
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                (toxic if y else clean).update({g for w in set(t.lower().split()) if (p := plain(w)) and len(p) > 2 for g in grams(p)})
            both = [g for g in toxic.keys() | clean.keys()]
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string()), pa.array([toxic[g] for g in both], pa.int64()), pa.array([clean[g] for g in both], pa.int64())], names=["entry", "toxic", "clean"])

    sums = mapped(sample, count, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    nt, nc = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not nt or not nc:
        return {}
    a, b, share = F.col("a"), F.col("b"), nt / (nt + nc)
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(F.lit(0.0))
    strength = 2 * (term(a, (a + b) * share) + term(b, (a + b) * (1 - share)))
    odds = ((a + 0.5) / (nt + 1)) / ((b + 0.5) / (nc + 1))
    sums = sums.filter(a + b >= ROWS).cache()
    least = 2 * np.log(max(2, sums.count()))
    found = sums.filter(a >= ROWS).select("entry", strength.alias("strength"), odds.alias("odds")).filter((F.col("strength") >= float(least)) & (F.col("odds") >= ODDS))
    out = {r[0]: float(np.log(r[2])) for r in found.orderBy(F.desc("strength"), "entry").limit(entries).collect()}
    sums.unpersist()
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """Fits on labelled rows that are not held out, about `sample` of them: the lexicon (at most `entries`) and the trees
    on two thirds, the calibration on the rest.

    Rows with a null label or doc_id, or without a document, are not used; a doc_id with several labels counts as
    toxic if one of them is. Without rows of both classes the score is the share of toxic rows (0.1 without any)."""
    own = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(remainder(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = min(1.0, sample / max(1, own.count()))
    own = own.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < int(share * 1_000_000)).withColumnRenamed("toxic", "label")
    texts = docs.select("doc_id", text_or_empty(docs).alias("text")).join(F.broadcast(own), "doc_id").select("text", F.col("label").alias("toxic"), (remainder(F.col("doc_id")) == CALIBRATE).alias("calibrate"), F.xxhash64("doc_id", "text").alias("place"))
    texts = written(texts, "labelled")
    train = texts.filter("NOT calibrate")
    lexicon = learn_lexicon(train, entries)

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon)
        for b in it:
            x = features.matrix(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("toxic"), b.column("calibrate"), b.column("place"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "calibrate", "place", "x"])

    got = sorted(mapped(texts, rows, "toxic int, calibrate boolean, place long, x array<double>").collect(), key=lambda r: (r["place"], r["toxic"]))
    x, y, late = np.array([r["x"] for r in got], float).reshape(-1, len(NAMES)), np.array([r["toxic"] for r in got], float), np.array([r["calibrate"] for r in got], bool)
    trees = Boosted().fit(x[~late], y[~late])
    if late.any() and trees.nodes:
        trees.calibrate(x[late], y[late])
    return Model(lexicon, trees)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds `out` (0 to 1, higher: toxic likelier) to every row; null text counts as empty and has a score, too. A
    column already named so is replaced; other columns pass through, rows are not moved. Repeated rows score alike, and
    an empty table stays empty."""
    df = df.drop(out)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(model.lexicon)
        for b in it:
            s = model.trees.score(features.matrix([t or "" for t in b.column(text).to_pylist()])) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, out])

    return mapped(df, batches, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model fitted on the labelled rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    s = score(docs.select("doc_id", "text"), model)
    return s.select("doc_id", (remainder(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents scored at THRESHOLD or more go. All others stay, row by row: null and empty texts have a
    score like any other, repeated rows go or stay together, an empty table stays empty."""
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    name = fresh(docs, "toxicity")[0]
    return score(docs, model, out=name).filter(F.col(name) < THRESHOLD).select(*docs.columns)


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}
