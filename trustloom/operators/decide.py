"""Splitters (trust to keep or drop), handlers, and weak-label encoders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustloom.functions import expr as E
from trustloom.sources.store import stored

# Splitters: (id, y, trust columns) -> the same with trusted (boolean) -------------------------


@dataclass
class ThresholdSplitter:
    """Every trust column is at least the threshold."""

    threshold: float = 0.0

    def split(self, df: DataFrame, *scores: str) -> DataFrame:
        keep = F.lit(True)
        for s in scores:
            keep = keep & (F.col(s) >= F.lit(self.threshold))
        return df.withColumn("trusted", keep)


@dataclass
class QuantileSplitter:
    """Every column is at least its quantile; with s columns the rate is 1 - (1 - q)^(1 / s).

    Exact quantiles with linear interpolation, found by narrowing histograms:
    the driver sees BINS counts a class and round. ``by`` takes the quantiles
    within a class (T04).
    """

    quantile: float = 0.5

    def split(self, df: DataFrame, *scores: str, by: str | None = None) -> DataFrame:
        q = 1 - (1 - self.quantile) ** (1 / len(scores))
        narrow = stored(df.select(*([by] if by else []), *scores), "scores")
        keep = F.lit(True)
        for s in scores:
            cut = None
            for group, value in quantiles(narrow, s, q, by).items():
                here = F.lit(True) if by is None else F.col(by).eqNullSafe(F.lit(group))
                cut = F.when(here, F.lit(value)) if cut is None else cut.when(here, F.lit(value))
            keep = keep & (F.col(s) >= cut) if cut is not None else keep
        return df.withColumn("trusted", keep)


BINS = 1024


def quantiles(rows: DataFrame, score: str, q: float, by: str | None = None) -> dict:
    """The exact quantile of ``score``, interpolated, for each class of ``by`` (None without it).

    The two values next to the quantile are looked for at once: each round
    counts the rows of a range in BINS bins and goes on with the bin that holds
    the rank, until that holds one value. Nulls don't count.
    """
    group = F.col(by) if by else F.lit(None).cast("int")
    rows = rows.select(group.alias("g"), F.col(score).cast("double").alias("s")).filter("s is not null")
    spans = rows.groupBy("g").agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect()  # a row a class
    todo, found = {}, {}
    for k, r in enumerate(spans):
        at = (r["n"] - 1) * q
        for j in (0, 1):
            todo[2 * k + j] = [r["g"], r["low"], r["high"], min(int(at) + j, r["n"] - 1)]
    while todo:
        for t, (_, low, high, _) in list(todo.items()):
            if low == high:
                found[t] = low
                del todo[t]
        if not todo:
            break
        marks = []
        for t, (g, low, high, _) in todo.items():
            inside = F.col("g").eqNullSafe(F.lit(g)) & F.col("s").between(low, high)
            place = F.least(F.floor((F.col("s") - F.lit(low)) / F.lit(high - low) * F.lit(BINS)), F.lit(BINS - 1))
            marks.append(F.when(inside, F.struct(F.lit(t).alias("t"), place.alias("b"))))
        counted = rows.select("s", F.explode(F.array_compact(F.array(*marks))).alias("m")).groupBy("m.t", "m.b")
        bins: dict[int, list] = {}
        for r in counted.agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high")).collect():  # at most BINS rows a rank
            bins.setdefault(r["t"], []).append((r["b"], r["n"], r["low"], r["high"]))
        for t, parts in bins.items():
            rank = todo[t][3]
            for _, n, low, high in sorted(parts):
                if rank < n:
                    todo[t][1:] = [low, high, rank]
                    break
                rank -= n
    out = {}
    for k, r in enumerate(spans):
        at = (r["n"] - 1) * q
        out[r["g"]] = found[2 * k] + (found[2 * k + 1] - found[2 * k]) * (at - int(at))
    return out


@dataclass
class GmmSplitter:
    """Two Gaussians on min-max scaled trust, by a fixed number of EM steps from the extremes.

    A row is kept if it belongs to the component with the larger mean. One
    aggregation of six sums a step; the start is fixed, so results repeat.
    """

    steps: int = 8
    floor: float = 1e-3

    def split(self, df: DataFrame, score: str = "trust") -> DataFrame:
        rows = stored(df.select(score), "scores")  # the steps read scores, not what they come from
        lo, hi = rows.agg(F.min(score), F.max(score)).first()
        width = (hi - lo) if hi is not None and hi > lo else 1.0
        s = (F.col(score) - F.lit(lo if lo is not None else 0.0)) / F.lit(width)
        mean, var, share = [0.25, 0.75], [0.0625, 0.0625], [0.5, 0.5]
        for _ in range(self.steps):
            r = self._high(s, mean, var, share)
            n, n1, a0, a1, b0, b1 = rows.agg(F.count("*"), F.sum(r), F.sum((1.0 - r) * s), F.sum(r * s), F.sum((1.0 - r) * s * s), F.sum(r * s * s)).first()
            if not n:
                break
            weights = [max(n - n1, 1e-9), max(n1, 1e-9)]
            mean = [a0 / weights[0], a1 / weights[1]]
            var = [max(b / w - m * m, self.floor) for b, w, m in zip((b0, b1), weights, mean)]
            share = [w / n for w in weights]
        p = self._high(s, mean, var, share)
        return df.withColumn("trusted", p >= 0.5 if mean[1] >= mean[0] else p < 0.5)

    @staticmethod
    def _high(s: Column, mean, var, share) -> Column:
        import math

        log = [F.lit(math.log(share[k]) - 0.5 * math.log(var[k])) - (s - F.lit(mean[k])) * (s - F.lit(mean[k])) / F.lit(2 * var[k]) for k in (0, 1)]
        return E.logistic(log[1] - log[0])


@dataclass
class MixtureSplitter:
    """T03 over several scores: two Gaussians of full covariance on min-max scaled columns, by fixed EM steps.

    Starts from a quarter and three quarters of every column's range. One
    aggregation of weights, sums and products a step, whatever the rows. A row
    is kept if it belongs to the component whose means add up to more; rows with
    a null score are not. ``floor`` is added to the variances.
    """

    steps: int = 8
    floor: float = 1e-3

    def split(self, df: DataFrame, *scores: str) -> DataFrame:
        d = len(scores)
        rows = stored(df.select(*[F.col(c).cast("double").alias(f"s{k}") for k, c in enumerate(scores)]).dropna(), "scores")
        lim = rows.agg(*[F.min(f"s{k}") for k in range(d)], *[F.max(f"s{k}") for k in range(d)]).first()
        low = [v if v is not None else 0.0 for v in lim[:d]]
        width = [(hi - lo) if hi is not None and hi > lo else 1.0 for lo, hi in zip(low, lim[d:])]
        scaled = lambda names: [(F.col(c).cast("double") - F.lit(lo)) / F.lit(w) for c, lo, w in zip(names, low, width)]
        s = scaled([f"s{k}" for k in range(d)])
        mean, cov, share = [np.full(d, 0.25), np.full(d, 0.75)], [np.eye(d) / 16] * 2, [0.5, 0.5]
        pairs = [(i, j) for i in range(d) for j in range(i, d)]
        for _ in range(self.steps):
            high = E.held(rows, r=self._high(s, mean, cov, share))
            parts = [(F.col("r"), 1), (1.0 - F.col("r"), 0)]
            sums = [F.sum(r * v) for r, _ in parts for v in [F.lit(1.0), *s, *[s[i] * s[j] for i, j in pairs]]]
            found = high.agg(*sums).first()
            if found[0] is None:
                break
            found, size = np.array(found, float), 1 + d + len(pairs)
            for (_, k), own in zip(parts, found.reshape(2, size)):
                n = max(own[0], 1e-9)
                mean[k] = own[1 : 1 + d] / n
                C = np.zeros((d, d))
                for (i, j), v in zip(pairs, own[1 + d :]):
                    C[i, j] = C[j, i] = v / n - mean[k][i] * mean[k][j]
                cov[k] = C + self.floor * np.eye(d)
                share[k] = n
            share = [v / sum(share) for v in share]
        p = self._high(scaled(scores), mean, cov, share)
        kept = p >= 0.5 if mean[1].sum() >= mean[0].sum() else p < 0.5
        return df.withColumn("trusted", F.coalesce(kept, F.lit(False)))

    @staticmethod
    def _high(s: list[Column], mean, cov, share) -> Column:
        def log(k: int) -> Column:
            inv, out = np.linalg.inv(cov[k]), F.lit(float(np.log(share[k]) - 0.5 * np.linalg.slogdet(cov[k])[1]))
            for i in range(len(s)):
                for j in range(len(s)):
                    out = out - (s[i] - F.lit(float(mean[k][i]))) * (s[j] - F.lit(float(mean[k][j]))) * F.lit(float(inv[i, j] / 2))
            return out

        return E.logistic(log(1) - log(0))


@dataclass
class PerClassSplitter:
    """A splitter within each class."""

    splitter: QuantileSplitter

    def split(self, df: DataFrame, *scores: str, y: str = "y") -> DataFrame:
        if isinstance(self.splitter, QuantileSplitter):
            return self.splitter.split(df, *scores, by=y)
        if isinstance(self.splitter, ThresholdSplitter):
            return self.splitter.split(df, *scores)
        out = None
        for r in df.select(y).distinct().collect():  # one row a class
            part = self.splitter.split(df.filter(F.col(y) == r[y]), *scores)
            out = part if out is None else out.unionByName(part)
        return out


# Handlers: rows with trusted -> what the final model learns from ------------------------------


def filter_untrusted(df: DataFrame) -> DataFrame:
    """H01."""
    return df.filter("trusted").drop("trusted")


def unlabel_untrusted(df: DataFrame, y: str = "y") -> DataFrame:
    """Untrusted labels become -1."""
    return df.withColumn(y, F.when(F.col("trusted"), F.col(y)).otherwise(F.lit(-1)).cast("int")).drop("trusted")


def weight_untrusted(df: DataFrame) -> DataFrame:
    """All rows stay, sample_quality is 1 or 0."""
    return df.withColumn("sample_quality", F.col("trusted").cast("int")).drop("trusted")


@dataclass
class HandleClassifier:
    """Labels encoded, trust scored, split, handled, and a final model fitted on what is left.

    Labels may be of any type; ``predict`` gives them back. ``handler`` is one of
    the three above; -1 labels are left out of the final fit, and a
    sample_quality goes into it as the row's weight.
    """

    detector: object
    splitter: object
    fit: Callable[[DataFrame, int], object]
    handler: Callable[[DataFrame], DataFrame] = filter_untrusted

    def run(self, df: DataFrame) -> "HandleClassifier":
        names = [r["y"] for r in df.select("y").distinct().orderBy("y").collect()]  # one row a class
        self.classes = names
        code = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("y")) - 1
        rows = df.withColumn("y", code.cast("int"))
        trust = self.detector.trust_score(rows)
        self.marked = self.splitter.split(rows.join(trust, "id"), "trust")
        rows = self.handler(self.marked)
        weights = [c for c in ("sample_quality",) if c in rows.columns]
        self.model = self.fit(rows.filter("y >= 0").select("id", "x", "y", *weights), len(names))
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        names = F.array(*[F.lit(n) for n in self.classes])
        return df.withColumn("prediction", F.get(names, self.model.predictions(F.col("x"))))


# Weak labels ----------------------------------------------------------------------------------

PUNCTUATION = ':,.?!"'


def tokens(text: Column) -> Column:
    """1-grams and 2-grams of a text in lower case, without the punctuation above."""
    return E.let(_words(text), lambda one: F.concat(one, _pairs(one, lambda a, b: F.concat_ws(" ", a, b))))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.trim(F.lower(F.translate(text, PUNCTUATION, ""))), r"\s+"), lambda t: t != "")


def _pairs(one: Column, of: Callable[[Column, Column], Column]) -> Column:
    n = F.greatest(F.size(one) - 1, F.lit(0))
    return F.slice(F.zip_with(one, F.slice(one, 2, n), of), 1, n)


def held_keywords(text: Column, keywords: list[str]) -> Column:
    """Which of ``keywords``, of one or two words, a text holds: its tokens go once through a hash set of them.

    Pairs are only put together behind a keyword's first word.
    """
    known = F.array(*[F.lit(k) for k in sorted(set(keywords))])
    firsts = sorted({k.split(" ")[0] for k in keywords if " " in k})

    def found(one: Column) -> Column:
        if not firsts:
            return F.array_intersect(one, known)
        return F.array_intersect(F.concat(one, _pairs(one, lambda a, b: F.when(a.isin(firsts), F.concat_ws(" ", a, b)))), known)

    return E.let(_words(text), found)


def keyword_votes(text: Column, rules: dict[int | str, list[str]]) -> Column:
    """A vote for each keyword, in order: its rule's label where the text holds it, else -1."""
    flat = [(label, k.lower()) for label, words in rules.items() for k in words]
    vote = lambda held, label, k: F.when(F.array_contains(held, k), F.lit(label)).otherwise(F.lit(-1) if isinstance(label, int) else F.lit("-1"))
    return E.let(held_keywords(text, [k for _, k in flat]), lambda held: F.array(*[vote(held, label, k) for label, k in flat]))


def priority_votes(text: Column, first: dict[str, list[str]], rules: dict[str, list[str]]) -> Column:
    """Priority keywords first; the first match among them makes every other vote abstain."""
    lead = [(label, k.lower()) for label, words in first.items() for k in words]
    rest = [(label, k.lower()) for label, words in rules.items() for k in words]

    def votes(held: Column) -> Column:
        taken, out = F.lit(False), []
        for label, k in lead:
            hit = F.array_contains(held, k)
            out.append(F.when(hit & ~taken, F.lit(label)).otherwise(F.lit("-1")))
            taken = taken | hit
        out += [F.when(F.array_contains(held, k) & ~taken, F.lit(label)).otherwise(F.lit("-1")) for label, k in rest]
        return F.array(*out)

    return E.let(held_keywords(text, [k for _, k in lead + rest]), votes)


@dataclass
class WeakLabelEncoder:
    """Votes (array, -1 abstains) to one label, or to the share of votes for each class.

    Ties go to the smallest class. Without a vote the majority is -1 and the
    soft label an array of nulls (the division has no value).
    """

    method: str = "majority"

    def fit(self, df: DataFrame, votes: str = "votes") -> "WeakLabelEncoder":
        if self.method not in ("majority", "soft"):
            raise ValueError(f"unknown method {self.method!r}")
        rows = df.select(F.explode(votes).alias("v")).filter(F.col("v").cast("string") != "-1").distinct()
        self.classes = sorted(r["v"] for r in rows.collect())  # one row a class
        return self

    def transform(self, df: DataFrame, votes: str = "votes", to: str = "weak") -> DataFrame:
        counts = F.array(*[self._count(votes, c) for c in self.classes])
        if self.method == "majority":
            return df.withColumn(to, E.let(counts, lambda c: F.when(F.array_max(c) > 0, E.argmax(c)).otherwise(F.lit(-1))))
        whole = lambda c: F.aggregate(c, F.lit(0), lambda a, v: a + v)
        return df.withColumn(to, E.let(counts, lambda c: E.let(whole(c), lambda n: F.transform(c, lambda v: F.try_divide(v, n)))))

    def fit_transform(self, df: DataFrame, votes: str = "votes", to: str = "weak") -> DataFrame:
        """Both, with the rows stored in between: votes are taken from the texts once."""
        rows = stored(df, "votes")
        return self.fit(rows, votes).transform(rows, votes, to)

    @staticmethod
    def _count(votes: str, c) -> Column:
        return F.size(F.filter(votes, lambda v: v == F.lit(c)))

    def inverse(self, df: DataFrame, code: str = "weak", to: str = "name") -> DataFrame:
        return df.withColumn(to, F.get(F.array(*[F.lit(c) for c in self.classes]), F.nullif(F.col(code), F.lit(-1))))
