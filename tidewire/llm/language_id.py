"""Language identification by multilingual mixture inference.

Training counts hashed byte n-grams (2, 3 and 4 bytes of lower-cased words with a space at each end) per language, over
about `sample` labelled rows chosen by hash of their key. A document is a mixture: each word has a likelihood per
language (the product of its n-grams'), expectation-maximisation estimates the languages' shares, and languages are
added in order of share while the likelihood less a penalty for each language (half the log of the number of words, and
the log of the number of languages to choose from) grows. The prediction is the language of the greatest share.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDERS = (2, 3, 4)
BUCKETS = 1 << 15
SAMPLE = 4000
ROUNDS = 8
RESULT = "lang_pred string, score double, langs array<struct<lang:string,share:double>>"
_LETTER = np.array([0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def _codes(data: np.ndarray) -> np.ndarray:
    """The bucket of each n-gram that begins at each byte, a column for each order; orders have buckets of their own."""
    padded = np.concatenate([data, np.zeros(max(ORDERS), np.uint8)]).astype(np.uint32)
    out, gram, n = [], np.zeros(len(data), np.uint32), 0
    for order in ORDERS:
        while n < order:
            gram = (gram << np.uint32(8)) | padded[n : n + len(data)]
            n += 1
        mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * order)
        out.append((mixed >> np.uint32(17)).astype(np.int64) + (len(out) * BUCKETS))
    return np.stack(out)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the lower-cased texts with other characters as spaces; begin, length (with both spaces) and text of each word."""
    raw = [t.lower().encode() for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    letter = _LETTER[data]
    data = np.where(letter, data, np.uint8(32))
    edge = np.diff(letter.astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 2  # with the space on either side
    ends = np.cumsum([len(r) + 1 for r in raw])
    return data, begin, end - begin, np.searchsorted(ends, begin, side="right")


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # log-likelihoods, a row for each bucket of each order, a column for each language

    def word_scores(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Log-likelihood of each word in each language: its n-grams' sum, by prefix sums over the block."""
        codes = _codes(data)
        n = len(data)
        total = np.zeros((n + 1, len(self.langs)))
        out = np.zeros((len(begin), len(self.langs)))
        for row, order in zip(codes, ORDERS, strict=True):
            np.cumsum(self.table[row], axis=0, out=total[1:])
            stop = np.maximum(begin + length - order + 1, begin)
            out += total[stop] - total[begin]
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, float]]]]:
        out: list[tuple[str, float, list[tuple[str, float]]]] = [("und", 0.0, [])] * len(texts)
        if not self.langs:
            return out
        use = [i for i, t in enumerate(texts) if t]
        data, begin, length, doc = words([texts[i] for i in use])
        if not len(begin):
            return out
        filled, first = np.unique(doc, return_index=True)
        size = np.diff(np.append(first, len(doc)))
        of = np.repeat(np.arange(len(filled)), size)
        scores = self.word_scores(data, begin, length)
        shares, single = self._mixture(scores, of, first, size)
        for k, d in enumerate(filled.tolist()):
            text = texts[use[d]]
            if not any(c.isalpha() for c in text):
                continue
            chosen = [(self.langs[j], float(shares[k, j])) for j in np.argsort(-shares[k], kind="stable").tolist() if shares[k, j] > 0]
            out[use[d]] = (chosen[0][0], min(1.0, chosen[0][1]), chosen)
        return out

    def _mixture(self, scores: np.ndarray, of: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the languages per document after selection."""
        n, k = len(first), scores.shape[1]
        top = scores.max(axis=1, keepdims=True)
        ratio = np.exp(scores - top)
        whole = self._em(ratio, of, first, size, np.full((n, k), 1.0 / k))
        order = np.argsort(-whole, axis=1, kind="stable")
        base = np.add.reduceat(scores, first, axis=0)
        best_one = base.argmax(axis=1)
        shares = np.zeros((n, k))
        shares[np.arange(n), best_one] = 1.0
        value = base[np.arange(n), best_one]
        tops = np.add.reduceat(top[:, 0], first)
        live = np.arange(n)
        for s in range(2, k + 1):
            if not len(live):
                break
            mask = np.zeros((len(live), k))
            np.put_along_axis(mask, order[live, :s], 1.0, axis=1)
            pick = np.isin(of, live) if len(live) < n else slice(None)
            sub = ratio[pick]
            sub_first = np.concatenate([[0], np.cumsum(size[live])[:-1]])
            sub_of = np.repeat(np.arange(len(live)), size[live])
            got = self._em(sub, sub_of, sub_first, size[live], mask * np.maximum(whole[live], 1e-6), rounds=4)
            ll = np.add.reduceat(np.log(np.maximum((sub * got[sub_of]).sum(axis=1), 1e-300)), sub_first) + tops[live]
            penalty = (s - 1) * (0.5 * np.log(size[live] + 1.0) + math.log(k))
            better = ll - penalty > value[live]
            live = live[better]
            shares[live], value[live] = got[better], (ll - penalty)[better]
        return shares, best_one

    @staticmethod
    def _em(ratio: np.ndarray, of: np.ndarray, first: np.ndarray, size: np.ndarray, share: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        share = share / share.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            part = ratio * share[of]
            part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
            share = np.add.reduceat(part, first, axis=0) / size[:, None]
        return share


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string")), F.lit(4)) == 2, F.lit(False))


def blocks(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of at least one text and else of at most so many characters."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= most):
            size += len(texts[to] or "")
            to += 1
        yield at, to
        at = to


def quotas(sizes: dict[str, int], sample: int) -> dict[str, float]:
    """Rows wanted of each group: all of small ones, and equal shares of what is left of the sample of the others."""
    out: dict[str, float] = {}
    left = float(sample)
    for k, (name, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        out[name] = min(float(n), left / (len(sizes) - k))
        left -= out[name]
    return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """From rows with a text and a language whose key isn't held out; about `sample` rows, taken by hash.

    Each language gives an equal share of the sample, or all its rows if it has fewer, so that rare ones are learned.
    """
    rows = docs.select(F.col(f"`{text}`").alias(text), F.col(f"`{lang}`").alias(lang), F.col(f"`{key}`").alias(key)).where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    sizes = {r[lang]: r["n"] for r in rows.groupBy(lang).agg(F.count("*").alias("n")).collect()}
    shares = quotas(sizes, sample)
    most = {name: int((1 << 30) * shares[name] / n) for name, n in sizes.items() if shares[name] < n}
    if most:
        limit = F.try_element_at(F.map_from_arrays(F.array(*map(F.lit, most)), F.array(*map(F.lit, most.values()))), F.col(lang))
        rows = rows.where(limit.isNull() | (F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(1 << 30)) < limit))

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in it:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == name]
                for a, b in blocks(own, 1 << 18):
                    data, begin, length, _ = words(own[a:b])
                    codes, into = _codes(data), sums.setdefault(name, np.zeros(len(ORDERS) * BUCKETS, np.int64))
                    for row, order in zip(codes, ORDERS, strict=True):
                        change = np.zeros(len(data) + 1, np.int64)
                        np.add.at(change, begin, 1)
                        np.add.at(change, np.maximum(begin + length - order + 1, begin), -1)
                        into += np.bincount(row[np.cumsum(change[:-1]) > 0], minlength=len(into))
        for name, into in sums.items():
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(into[at], pa.int64())], names=["lang", "at", "n"])

    counted = rows.select(text, lang).mapInArrow(count, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    table = np.zeros((len(ORDERS) * BUCKETS, len(langs)))
    for j, name in enumerate(langs):
        own = counted[counted["lang"] == name]
        table[own["at"].to_numpy(), j] = own["n"].to_numpy()
    for k in range(len(ORDERS)):
        part = table[k * BUCKETS : (k + 1) * BUCKETS]
        table[k * BUCKETS : (k + 1) * BUCKETS] = np.log((part + 0.5) / (part.sum(axis=0) + 0.5 * BUCKETS))
    return Model(langs, table)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (the share of lang_pred) and langs (all chosen languages with shares) to every row.

    A text that is null or has no letter is und with score 0, as is every text where no language was learned. Equal
    shares go to the language of the lesser name. Rows, repeated ones too, and other columns are kept; columns of these
    names are replaced. Long texts are worked on whole, a text at a time; an empty table gives no rows.
    """
    docs = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score", "langs")))
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(RESULT).fields])
    place, names = docs.columns.index(text), schema.names
    kinds = [pa.string(), pa.float64(), pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column(place).to_pylist()
            for a, b in blocks(texts, 1 << 18):
                got = model.predict(texts[a:b])
                new = [[g[0] for g in got], [g[1] for g in got], [[{"lang": x, "share": s} for x, s in g[2]] for g in got]]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *(pa.array(c, t) for c, t in zip(new, kinds, strict=True))], names=names)

    return docs.mapInArrow(run, schema)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's language, learned from documents that aren't held out; see train and identify for nulls and ties."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "langs")
