"""Language identification by error-correcting output codes.

Every language has a codeword; each bit of it is predicted by a binary classifier over hashed byte n-grams (log-odds
of an n-gram under the languages whose bit is 1 against those whose bit is 0). Decoding adds up a logistic loss
between the bits' margins and each codeword, weighted by how well a bit's classifier does on that language, and takes
the nearest codeword; a text is flagged as ambiguous if the runner-up is nearly as near.

Defined cases: a text that is null or has no letter is `und` with score 0; with no labelled row, all texts are `und`;
with one language, it is predicted for all; equal distances go to the first language by code point; repeated rows
count as often as they occur in training; an empty table gives an empty result; extra columns stay out. Texts are read
whole, in slices of SLICE bytes, and in training each n-gram counts as often as it occurs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.llm.shared import stored, unit

#: Hashed n-grams (a power of two), their lengths in bytes, and bytes handled at once.
DIMS, GRAMS, SLICE = 1 << 14, (2, 3, 4), 1 << 20
#: Training takes about so many rows of each language, chosen by a hash of the row's id: a bounded sample.
TRAIN_ROWS = 600
#: Below this gap between the two nearest languages' scores a text is ambiguous.
AMBIGUOUS = 0.2
_PLAIN = bytes(c if not (c < 128 and not chr(c).isalpha()) else 32 for c in range(256))


def codewords(n: int) -> np.ndarray:
    """n rows of ±1: all distinct splits for few languages, else random columns that keep rows far apart."""
    if n <= 6:
        columns = [c for c in itertools.product((1, -1), repeat=n) if c[0] == 1 and -1 in c]
        return np.array(columns, dtype=np.float64).T if columns else np.ones((n, 1))
    rng, bits, best = np.random.default_rng(7), int(np.ceil(10 * np.log2(n))), None
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        gap = min((a != b).sum() for a, b in itertools.combinations(code[:, :], 2)) if n <= 200 else 0
        if np.abs(code.sum(0)).max() < n and (best is None or gap > best[0]):
            best = (gap, code)
    return best[1]


def grams(text: str) -> Iterator[np.ndarray]:
    """Hashed n-grams of a lower-cased text, anything but letters taken as blanks; slices overlap, so none is lost."""
    raw = b" " + text.lower().encode("utf-8").translate(_PLAIN) + b" "
    reach = max(GRAMS) - 1
    for at in range(0, len(raw), SLICE):
        x = np.frombuffer(raw[max(0, at - reach) : at + SLICE], dtype=np.uint8).astype(np.uint32)
        new = len(x) - min(at, reach)
        for n in GRAMS:
            if len(x) < n:
                continue
            h = np.full(len(x) - n + 1, n, dtype=np.uint32)
            for k in range(n):
                h = h * np.uint32(0x01000193) ^ x[k : len(x) - n + 1 + k]
            h *= np.uint32(0x9E3779B1)
            yield (h >> np.uint32(32 - DIMS.bit_length() + 1))[-min(len(h), new) :]


def counts(text: str) -> np.ndarray:
    out = np.zeros(DIMS, dtype=np.int64)
    for g in grams(text):
        out += np.bincount(g, minlength=DIMS)
    return out


class Model:
    """languages, codewords (languages x bits), weights (n-grams x bits), trust (languages x bits, rows sum to 1)."""

    def __init__(self, languages: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray):
        self.languages, self.code, self.weights, self.trust = languages, code, weights.astype(np.float32), trust

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.code.shape[1]), 0
        for g in grams(text):
            total += self.weights[g].sum(0, dtype=np.float64)
            n += len(g)
        return total / max(1.0, n) * np.sqrt(min(n, 400))

    def scores(self, margins: np.ndarray) -> np.ndarray:
        """Of each language, by its codeword's weighted loss."""
        loss = (self.trust * np.logaddexp(0, -self.code * margins)).sum(1) * self.code.shape[1]
        e = np.exp(loss.min() - loss)
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or text is None or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        p = self.scores(self.margins(text))
        k = int(np.argmax(p))
        rest = np.partition(p, -2)[-2] if len(p) > 1 else 0.0
        return self.languages[k], float(p[k]), bool(p[k] - rest < AMBIGUOUS)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fit on about `rows` rows of each language. Counts are summed in Spark; the driver gets DIMS numbers a language."""
    labelled = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    there = labelled.groupBy(lang_col).count().collect()  # one row a language
    languages = sorted(r[0] for r in there)
    if not languages:
        return Model([], np.ones((0, 1)), np.zeros((DIMS, 1)), np.ones((0, 1)))
    share = F.create_map(*[F.lit(x) for r in there for x in (r[0], min(1.0, rows / r[1]))])
    sample = stored(labelled.filter(unit(F.col(id_col).cast("string"), F.lit(11)) < share[F.col(lang_col)]).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), "language-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                c = counts(text)
                sums[lang] = sums[lang] + c if lang in sums else c
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": lang, "gram": at.astype(np.int32), "n": c[at]})

    seen = np.zeros((DIMS, len(languages)))
    place = {x: i for i, x in enumerate(languages)}
    summed = sample.mapInPandas(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    seen[summed["gram"].to_numpy(), summed["lang"].map(place).to_numpy()] = summed["n"].to_numpy()
    share_of = (seen + 0.5) / (seen + 0.5).sum(0)
    code = codewords(len(languages))
    weights = np.zeros((DIMS, code.shape[1]))
    for b in range(code.shape[1]):
        ones, zeros = code[:, b] > 0, code[:, b] < 0
        if zeros.any() and ones.any():
            weights[:, b] = np.log(share_of[:, ones].mean(1)) - np.log(share_of[:, zeros].mean(1))
    draft = Model(languages, code, weights, np.full(code.shape, 1 / code.shape[1]))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            right = [((draft.margins(t) * code[place[x]]) > 0).astype(float).tolist() for x, t in zip(batch["lang"], batch["text"], strict=True)]
            yield pd.DataFrame({"lang": batch["lang"], "right": right})

    bits = range(code.shape[1])
    judged = sample.mapInPandas(judge, "lang string, right array<double>").groupBy("lang").agg(*[F.avg(F.col("right")[b]).alias(f"b{b}") for b in bits]).collect()
    trust = np.full(code.shape, 1e-3)
    for r in judged:
        trust[place[r[0]]] += np.array(r[1:])
    return Model(languages, code, weights, trust / trust.sum(1, keepdims=True))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep`, lang_pred, score (0 to 1) and ambiguous for each row; one pass, only the model is sent to the tasks."""
    plain = docs.select(*keep, F.col(text_col).alias("__text"))
    told = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    schema = T.StructType([*[f for f in plain.schema.fields if f.name != "__text"], *fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = told.value
        for batch in batches:
            names = [x for x in batch.schema.names if x != "__text"]
            got = [m.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index("__text"))]
            out = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(x)) for x in names], *out], [f.name for f in schema.fields])

    return plain.mapInArrow(work, schema)


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """Whether a row is kept from training, by the CRC of its id; a row without an id isn't."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(mod)) == remainder, F.lit(False))
