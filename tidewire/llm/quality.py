"""Quality classifier with hierarchical empirical Bayes.

A logistic model on counts of a text's characters and words gives each document's evidence; it is fitted to about
`sample` labelled rows chosen by hash. Expected numbers of good documents are summed per section (site and path) and
site; each section's rate is shrunk towards its site's and each site's towards the global rate, with strengths
estimated from the spread between groups, so sparse groups stay near their parent. A document's posterior replaces the
training prior in its evidence with its section's rate, from which its own evidence is left out: it counts once.

Sums are of whole billionths, so they don't depend on the order of rows. Null sites and sections are groups of their own,
a null probability is the training prior, null and empty texts have the evidence of an empty text. Rows, repeated ones
too, and other columns are kept; columns of the added names are replaced. Long texts are worked on in one piece of at
least one text; an empty table gives no rows, and no labels an even model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.llm.common import cut, without
from tidewire.llm.language_id import blocks

SAMPLE = 4000
#: Section tables up to this number of rows are broadcast (about 60 bytes each); larger ones join by shuffle.
BROADCAST_SECTIONS = 100_000
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 1e4
#: Character classes: 0 other, 1 a-z and above ASCII, 2 A-Z, 3 digit, 4 white space, 5 sentence punctuation, 6 symbols.
_CLASS = np.array([1 if 0x61 <= b <= 0x7A or b >= 0x80 else 2 if 0x41 <= b <= 0x5A else 3 if 0x30 <= b <= 0x39 else 4 if b in (9, 10, 11, 12, 13, 32) else 5 if chr(b) in ".,;:'\"?!()-" else 6 if 33 <= b < 127 else 0 for b in range(256)], np.int8)
_BYTE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)


def features(texts: list[str | None]) -> np.ndarray:
    """A row for each text: shares of character classes, '!' and '|', repeated and distinct words, word and sentence lengths, size."""
    raw = [(t or "").encode() + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    n = len(raw)
    size = np.array([len(r) for r in raw])
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    cls = _CLASS[data]
    share = lambda mask: np.add.reduceat(mask, first, dtype=np.int64) / size
    space = cls == 4
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    doc = np.searchsorted(first, begin, side="right") - 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data | ((cls == 2) * 32).astype(np.uint8)], out=sums[1:])
    word = (sums[end] - sums[begin]) ^ (end - begin).astype(np.uint64)  # a hash of the letters, whatever their order
    count = np.maximum(np.bincount(doc, minlength=n), 1)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((word, doc))
    fresh = np.ones(len(word), bool)
    fresh[1:] = (word[order][1:] != word[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][fresh], minlength=n)
    tail = cls[end - 1] if len(end) else cls[:0]
    ends = np.bincount(doc[tail == 6], minlength=n) / count
    marks = np.bincount(doc[data[end - 1] == 33] if len(end) else doc, minlength=n) / count
    stops = np.bincount(doc[data[end - 1] == 46] if len(end) else doc, minlength=n)
    return np.stack(
        [
            share(cls == 1), share(cls == 2), share(cls == 3), share(cls == 5), share(cls == 6), share(data == 33), share(data == 124), share(data == 10), np.bincount(doc[again], minlength=n) / count,
            distinct / count, np.log1p(distinct), np.log1p(count), (size - np.add.reduceat(space, first, dtype=np.int64)) / count, ends, marks, np.log1p(count / (stops + 1)),
        ],
        axis=1,
    )


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the features, their squares and 1
    prior: float

    @staticmethod
    def widen(x: np.ndarray) -> np.ndarray:
        x = np.clip(x, -6, 6)
        return np.concatenate([x, x * x, np.ones((len(x), 1))], axis=1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> Model:
        """Penalised logistic regression by Newton steps; no rows give an even model."""
        if not len(x):
            return cls(np.zeros(16), np.ones(16), np.zeros(33), 0.5)
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = cls.widen((x - mean) / scale)
        w = np.zeros(z.shape[1])
        keep = np.full(len(w), ridge)
        keep[-1] = 1e-3
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
            w += step
            if np.abs(step).max() < 1e-7:
                break
        return cls(mean, scale, w, float(np.clip(y.mean(), 0.01, 0.99)))

    def probability(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        z = self.widen((features(texts) - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -15, 15)))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """From documents with a label of 0 or 1; several labels of a key are averaged, null ones are left out."""
    rows = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.avg(label).alias("__y"))
    n = rows.count()
    if n > sample:
        rows = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit(23)), F.lit(1 << 30)) < int((1 << 30) * sample / n))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(0).to_pylist()
            for a, b in blocks(texts, 1 << 19):
                x = features(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.slice(a, b - a).column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    # the sample bounds what is broadcast and what comes to the driver
    got = docs.select(F.col(key), F.col(text)).join(F.broadcast(rows), key).select(text, "__y").mapInArrow(run, "y double, x array<double>").toPandas()
    return Model.fit(np.array(got["x"].tolist()).reshape(len(got), -1 if len(got) else 16), got["y"].to_numpy(float))


def evidence(docs: DataFrame, model: Model, text: str = "text", out: str = "p_doc") -> DataFrame:
    """Adds the document classifier's probability to every row; a column of that name is replaced. Null texts count as empty."""
    docs = without(docs, out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])
    place, names = docs.columns.index(text), schema.names

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(place).to_pylist()
            for a, b in blocks(texts, 1 << 19):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(model.probability(texts[a:b]), pa.float64())], names=names)

    return docs.mapInArrow(run, schema)


def _strength(groups: DataFrame, n: str, good: str, parent: str) -> float:
    """How many documents a parent's rate is worth: from the spread of the groups' rates beyond what counting explains; to six digits."""
    m = F.col(good) / F.col(n)
    r = groups.agg(
        F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(F.col(n) * F.col(n)).alias("nn"), F.sum(F.col(n) * (m - F.col(parent)) ** 2).alias("between"), F.sum(F.col(n) * m * (1 - m)).alias("within"),
    ).first()
    if not r["n"] or r["k"] < 2:
        return LEAST_STRENGTH
    within = r["within"] / r["n"]
    spread = (r["between"] - (r["k"] - 1) * within) / (r["n"] - r["nn"] / r["n"])
    return float(f"{np.clip(within / spread if spread > 1e-12 else MOST_STRENGTH, LEAST_STRENGTH, MOST_STRENGTH):.6g}")


def rates(scored: DataFrame, prior: float = 0.5, site: str = "site", section: str = "section", p: str = "p_doc") -> DataFrame:
    """(site, section) -> section_rate, site_rate and global_rate by grouped sums, and the sums that judge takes a row's own part out of."""
    whole = F.round(F.coalesce(F.col(f"`{p}`"), F.lit(prior)) * 1_000_000_000).cast("long")
    sections = cut(scored.groupBy(F.col(f"`{site}`").alias("__site"), F.col(f"`{section}`").alias("__section")).agg(F.count("*").alias("__n"), (F.sum(whole).cast("decimal(38,0)")).alias("__w")), "sections")
    sections = sections.select("__site", "__section", "__n", (F.col("__w") / F.lit(1_000_000_000)).cast("double").alias("__good"), "__w")
    total = sections.agg(F.sum("__n").alias("n"), F.sum("__w").alias("w")).first()
    n, good = total["n"] or 0, float(total["w"] or 0) / 1e9
    base = good / n if n else 0.5
    sites = sections.groupBy("__site").agg(F.sum("__n").alias("__site_n"), (F.sum("__w") / F.lit(1_000_000_000)).cast("double").alias("__site_good"))
    k = _strength(sites.withColumn("__whole", F.lit(base)), "__site_n", "__site_good", "__whole")
    named = sites.withColumnRenamed("__site", "__s")
    both = cut(sections.drop("__w").join(named, F.col("__site").eqNullSafe(F.col("__s"))).drop("__s"), "sites")
    shrunk = both.withColumn("__parent", (F.lit(k * base) + F.col("__site_good")) / (F.lit(k) + F.col("__site_n")))
    j = _strength(shrunk, "__n", "__good", "__parent")
    named = shrunk.withColumns({
        site: F.col("__site"), section: F.col("__section"), "section_rate": (F.lit(j) * F.col("__parent") + F.col("__good")) / (F.lit(j) + F.col("__n")), "site_rate": F.col("__parent"), "global_rate": F.lit(base),
        "__all_n": F.lit(n).cast("long"), "__all_good": F.lit(good), "__k": F.lit(k), "__j": F.lit(j),
    })
    return cut(named.drop("__site", "__section", "__parent"), "rates")


def judge(scored: DataFrame, table: DataFrame, model: Model, threshold: float = 0.5, site: str = "site", section: str = "section", p: str = "p_doc") -> DataFrame:
    """Adds section_rate, site_rate, p_good and keep (p_good >= threshold) to scored rows.

    Both rates are those of the other documents: the row's own evidence is taken out of every sum.
    """
    few = table.count() <= BROADCAST_SECTIONS
    table = table.select(F.col(f"`{site}`").alias("__site"), F.col(f"`{section}`").alias("__section"), "__n", "__good", "__site_n", "__site_good", "__all_n", "__all_good", "__k", "__j")
    scored = without(scored, "section_rate", "site_rate", "p_good", "keep")
    columns = [F.col(f"`{c}`") for c in scored.columns]
    logit = lambda c: F.log(c / (1 - c))
    inside = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    own = F.coalesce(F.col(f"`{p}`"), F.lit(model.prior))
    joined = scored.join(F.broadcast(table) if few else table, F.col(f"`{site}`").eqNullSafe(F.col("__site")) & F.col(f"`{section}`").eqNullSafe(F.col("__section")))
    top = F.when(F.col("__all_n") > 1, (F.col("__all_good") - own) / (F.col("__all_n") - 1)).otherwise(0.5)
    joined = joined.withColumn("__top", top)
    joined = joined.withColumn("__up", (F.col("__k") * F.col("__top") + F.col("__site_good") - own) / (F.col("__k") + F.col("__site_n") - 1))
    joined = joined.withColumn("__in", (F.col("__j") * F.col("__up") + F.col("__good") - own) / (F.col("__j") + F.col("__n") - 1))
    odds = logit(inside(own)) - F.lit(float(np.log(model.prior / (1 - model.prior)))) + logit(inside(F.col("__in")))
    p_good = F.round(1 / (1 + F.exp(-odds)), 12)
    return joined.select(*columns, F.round("__in", 12).alias("section_rate"), F.round("__up", 12).alias("site_rate"), p_good.alias("p_good"), (p_good >= threshold).alias("keep"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's evidence and posterior; documents have no urls, so the source stands for the host and the language for the path."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = cut(evidence(docs.select("doc_id", F.col("source").alias("site"), F.col("lang").alias("section"), "text"), model).drop("text"), "evidence")
    return judge(scored, rates(scored, model.prior), model).select("doc_id", "site", "section", "p_doc", "site_rate", "section_rate", "p_good", "keep")
