"""Language identification by compression.

Each language has a raw-content zstandard dictionary, made of whole labelled texts. A text is normalised,
compressed in blocks with every dictionary, and gets the language whose blocks are smallest in sum, whatever its length.
The margin over the second smallest decides whether the choice is accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import zstandard
from pyspark.sql import DataFrame, Window

from rasterspark.llm.textbytes import release

UNKNOWN = "und"
SAMPLE_DOCS = 24  # bound of the labelled sample: distinct texts of each language, taken whole
BLOCK = 4096
SEARCH = 3  # of the match finder, as a power of two
MIN_MARGIN = 0.005

_MAP = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
_DROP = bytes(b for b in range(128) if not chr(b).isalpha() and b not in (9, 10, 11, 12, 13, 32))


def normalise(text: str | None) -> bytes:
    """Lower-case bytes without ASCII digits and punctuation; empty if there is no letter."""
    if not text:
        return b""
    out = text.lower().encode("utf-8", "surrogateescape").translate(_MAP, _DROP)
    if out.isascii():
        return out if out.strip() else b""
    return out if any(c.isalpha() for c in text) else b""


@dataclass(frozen=True)
class Model:
    """Languages by falling share of the labelled texts (ties by name) and their dictionaries."""

    langs: tuple[str, ...]
    dictionaries: tuple[bytes, ...]
    block: int = BLOCK

    def sizes(self, data: bytes) -> list[int]:
        """What the normalised text costs in each language."""
        blocks = [data[i : i + self.block] for i in range(0, len(data), self.block)]
        return [sum(len(c.compress(b)) for b in blocks) for c in _tools(self)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and margin, 1 - smallest / second smallest size; no letters: `und` and 0.

        Equal sizes go to the language with the larger share. With one language the margin is 1.
        """
        data = normalise(text)
        if not data or not self.langs:
            return UNKNOWN, 0.0
        sizes = self.sizes(data)
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        if len(order) == 1:
            return self.langs[0], 1.0
        return self.langs[order[0]], 1.0 - sizes[order[0]] / sizes[order[1]]


@lru_cache(maxsize=1)
def _tools(model: Model) -> list[zstandard.ZstdCompressor]:
    """A compressor for each language, whose window holds the dictionary and a block."""
    out = []
    for raw in model.dictionaries:
        window = max(15, (len(raw) + model.block).bit_length())
        table = min(window, 20)
        how = zstandard.ZstdCompressionParameters(
            window_log=window, hash_log=table, chain_log=table, search_log=SEARCH, min_match=3, target_length=32, strategy=zstandard.STRATEGY_BTLAZY2, write_checksum=False, write_content_size=False, write_dict_id=False
        )
        own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(dict_data=own, compression_params=how))
    return out


def train(labelled: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on `sample_docs` distinct texts of each language at most, chosen by a hash of the text, each taken whole.

    All rows are counted; a language with fewer texts gives all of them, and none is left out that has a letter. Rows with a
    null text or language, or without a letter, teach nothing. Copies of a text count once, whatever their ids.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"))
    rows = rows.where(F.col("text").rlike(r"\p{L}"))
    share = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(share, key=lambda x: (-share[x], x))
    if not langs:
        return Model((), ())
    # a part that surely has enough texts, unless most are copies; then its distinct texts by hash
    part = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, 8 * sample_docs / share[k]))])
    own = rows.withColumn("h", F.xxhash64("text"))
    some = own.where(F.pmod("h", F.lit(1 << 30)) / float(1 << 30) < part[F.col("lang")])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = some.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= sample_docs).drop("place")
    taken = some.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).orderBy("lang", "h").collect()  # bounded by the parameter
    texts: dict[str, list[bytes]] = {k: [] for k in langs}
    for r in taken:
        texts[r["lang"]].append(normalise(r["text"]))
    found = {k: b" ".join(filter(None, v)) for k, v in texts.items()}
    known = [k for k in langs if found[k]]
    # zstd takes no dictionary below 8 bytes, so a shorter one is repeated
    return Model(tuple(known), tuple(found[k] if len(found[k]) >= 8 else (found[k] + b" ") * 8 for k in known))


PREDICTED = "lang_pred string, score double, accepted boolean"


def predict(df: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Add lang_pred, score (the margin) and accepted to every row, from the whole text alone.

    accepted: a language was found and the margin is at least `min_margin`. Columns of those names are
    replaced; `keep` names the columns to carry (all by default). Null and letterless texts give `und`, 0
    and false. The model is a few dictionaries of bounded size and travels with the task.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(PREDICTED)
    keep = [c for c in (df.columns if keep is None else keep) if c not in added.fieldNames()]
    schema = StructType([df.schema[c] for c in keep] + added.fields)
    arrow = to_arrow_schema(schema)
    # the text comes last under a name that no kept column has
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            margins = np.array([m for _, m in got], float)
            known = np.array([g != UNKNOWN for g, _ in got], bool)
            columns = [batch.column(i).cast(arrow.field(i).type) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([g for g, _ in got], pa.string()), pa.array(margins), pa.array(known & (margins >= min_margin))], schema=arrow)
        release()

    return rows.mapInArrow(run, schema)


def keep(df: DataFrame, model: Model, *, text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of `df`, with all their columns, whose text is accepted; only the text goes through Python."""
    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.types import BooleanType

    @arrow_udf(BooleanType())
    def accepted(column: pa.Array) -> pa.Array:
        got = (model.predict(t.as_py()) for t in column)
        out = pa.array([lang != UNKNOWN and margin >= min_margin for lang, margin in got], pa.bool_())
        release()
        return out

    return df.where(accepted(F.col(f"`{text}`").cast("string")))
