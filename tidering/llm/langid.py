"""Language identification by nearest centroid.

Texts become L2-normalised TF-IDF vectors of hashed character n-grams of one to three
characters. Each language has several centroids, clustered from a bounded sample of
labelled rows; a text takes the language of the centroid of greatest cosine. A text is
rejected if it has no letter, or if its cosine is under a bound taken from how close
the language's own sample rows are.

The sample: of each language, the rows whose hashed id falls under the fraction that
gives SAMPLE_A_LANGUAGE rows on average (all, if fewer). The whole of each text counts,
in the sample and when predicting. lang, source and doc_id are no inputs of a prediction.

Null or letterless texts: `und`, score 0, rejected. With no labelled row to learn from,
every text is `und` and none with a letter is rejected. Rows of one doc_id, and texts
that repeat, are each predicted alike; equal cosines go to the smaller language name.
An empty table gives an empty result. Kept columns with the name of a result column are
an error; others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, disjoint, fold

#: Bounds of what is learnt from: rows of a language on average, and languages' rows in total.
SAMPLE_A_LANGUAGE, SAMPLE_ROWS = 400, 4000
DIMS, CENTROIDS = 4096, 3
#: A text is rejected below this share of the cosine that 99 % of its language's sample exceed.
REJECT_SHARE = 0.4
UNKNOWN = "und"
_SHIFT = np.uint32(32 - 12)
_C = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of the whole lower-cased text."""
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    h = (c + np.uint32(1)) * _C[0]
    out = np.bincount(h >> _SHIFT, minlength=DIMS)
    g = h[:-1]
    for n in (1, 2):
        g = (g ^ (g >> np.uint32(15))) * _C[n] + h[n:]
        out += np.bincount((g * _C[0]) >> _SHIFT, minlength=DIMS)
        g = g[:-1]
    return out


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray  # the index of each centroid's language
    least: np.ndarray  # of each language

    def vector(self, text: str) -> np.ndarray:
        v = np.log1p(counts(text)).astype(np.float32) * self.idf
        n = np.linalg.norm(v)
        return v / n if n else v

    def predict(self, text: str | None) -> tuple[str, float, float, bool]:
        """Language, score, cosine, rejected."""
        if not has_letter(text):
            return UNKNOWN, 0.0, 0.0, True
        if not self.langs:
            return UNKNOWN, 0.0, 0.0, False
        cos = self.centroids @ self.vector(text)
        best = np.full(len(self.langs), -1.0)
        np.maximum.at(best, self.owner, cos)
        k = int(best.argmax())
        p = np.exp((best - best[k]) / 0.05)
        return self.langs[k], float(1 / p.sum()), float(best[k]), bool(best[k] < self.least[k])


def clustered(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means from evenly spaced rows; empty clusters are dropped."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        c = np.stack([x[near == i].mean(0) for i in range(len(c)) if (near == i).any()])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            b = whole.slice(at, 64)
            rows = [np.log1p(counts(x.as_py())).astype(np.float16).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["lang", "tf"])


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the labelled rows (id, text, lang); rows without lang, text or a letter teach nothing."""
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    bounded_batches(labelled.sparkSession)
    sizes = {r["lang"]: r["n"] for r in labelled.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros(DIMS), np.zeros((0, DIMS)), np.zeros(0, int), np.zeros(0))
    want = min(SAMPLE_A_LANGUAGE, max(1, SAMPLE_ROWS // len(sizes)))
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, want / n))])
    u = F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 30)) / float(1 << 30)
    rows = usable.where(u < share[F.col("lang")]).select("lang", "text").mapInArrow(_sampled, "lang string, tf binary").toArrow()
    names = np.array(rows.column("lang").to_pylist())
    tf = np.stack([np.frombuffer(x.as_py(), np.float16) for x in rows.column("tf")]) if len(names) else np.zeros((0, DIMS), np.float16)
    order = np.lexsort([*tf[:, :3].T, tf.sum(1, dtype=np.float32), names]) if len(names) else []
    names, tf = names[order], tf[order]
    idf = (np.log((1 + len(tf)) / (1 + (tf > 0).sum(0))) + 1).astype(np.float32)
    langs = sorted(set(names.tolist()))
    centroids, owner, least = [], [], []
    for i, lang in enumerate(langs):
        x = tf[names == lang].astype(np.float32) * idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = clustered(x, CENTROIDS)
        centroids.append(c)
        owner += [i] * len(c)
        least.append(REJECT_SHARE * np.quantile((x @ c.T).max(1), 0.01))
    return Model(langs, idf, np.concatenate(centroids) if centroids else np.zeros((0, DIMS)), np.array(owner, int), np.array(least))


def _predicted(model: Model, n_kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column(0)]
            cols = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1 : 1 + n_kept], *cols], names=[*batch.schema.names[1 : 1 + n_kept], "lang_pred", "score", "cosine", "rejected"])

    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns, lang_pred, score (0 to 1), cosine and rejected."""
    keep = keep if keep is not None else ["doc_id"]
    disjoint(keep, ["lang_pred", "score", "cosine", "rejected"])
    bounded_batches(docs.sparkSession)
    kept = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    ddl = ", ".join([*(f"`{c}` {t}" for c, t in kept.dtypes[1:]), "lang_pred string, score double, cosine double, rejected boolean"])
    return kept.mapInArrow(_predicted(model, len(keep)), ddl)


def identify_documents(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Learn from the rows of docs outside fold 0 and predict every row: id, held_out, lang_pred, score, cosine, rejected."""
    model = fit(docs.where(fold(F.col(id_col)) != 0), id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), (fold(F.col(id_col)) == 0).alias("held_out"), "text")
    return identify(rows, model, keep=["doc_id", "held_out"])
