"""Keyed upserts of entities and edges: replay-safe, independent of arrival order (an explicit sequence decides)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..plans.schemas import EDGE_DOMAINS
from ..sources.archive import archive


def fold_batch(batch: DataFrame, keys: list[str], seq: str, best_tier: str | None = None) -> DataFrame:
    """One row a key: the last non-null value of each column by the sequence, the best tier (map-side combined)."""
    rest = [c for c in batch.columns if c not in (*keys, seq)]
    if not rest:
        return batch.select(*keys).distinct()
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq)))
    return batch.groupBy(*keys).agg(*[(F.min(c) if c == best_tier else last(c)).alias(c) for c in rest])


def first_rows(schema: StructType, batch: DataFrame, key: str, seq: str, best_tier: str | None = "source_tier", defaults: dict | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """What ``upsert`` gives over an empty table of this schema, without the join."""
    new = fold_batch(batch, [key], seq, best_tier)
    new = finish(new) if finish else new
    empty = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields}
    out = new.select(*[F.coalesce(F.col(c), empty[c]).alias(c) if c in new.columns else empty[c].alias(c) for c in schema.names], *[c for c in new.columns if c not in empty])
    for c, fills in (defaults or {}).items():
        fill = F.when(F.col(key).isNotNull(), F.coalesce(*[F.col(f) if f in out.columns else F.lit(f) for f in fills]))
        out = out.withColumn(c, F.coalesce(*([F.col(c)] if c in out.columns else []), fill))
    return out


def upsert(current: DataFrame, batch: DataFrame, key: str, seq: str, best_tier: str | None = "source_tier", defaults: dict | None = None, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """New keys are inserted, existing rows take each non-null new value. A tier column keeps its best (lowest) value.

    defaults: column -> columns (or a literal) that fill it when it is null in the end, in the rows that the batch touches.
    finish: applied to the folded batch, such as making keys of their names.
    """
    new = fold_batch(batch, [key], seq, best_tier)
    new = finish(new) if finish else new
    cols = list(dict.fromkeys([*current.columns, *new.columns]))
    rename = lambda df, p: df.select(*[F.col(c).alias(f"{p}{c}") for c in df.columns])
    both = rename(current, "o_").join(rename(new, "n_"), F.col(f"o_{key}") == F.col(f"n_{key}"), "full_outer")

    def merged(c: str):
        old, fresh = (F.col(f"{p}{c}") if c in df.columns else None for p, df in (("o_", current), ("n_", new)))
        if old is None or fresh is None:
            return old if fresh is None else fresh
        return F.least(old, fresh) if c == best_tier else F.coalesce(fresh, old)

    out = both.select(*[merged(c).alias(c) for c in cols], F.col(f"n_{key}").isNotNull().alias("_touched"))
    for c, fills in (defaults or {}).items():
        fill = F.when(F.col("_touched"), F.coalesce(*[F.col(f) if f in cols else F.lit(f) for f in fills]))
        out = out.withColumn(c, F.coalesce(*([F.col(c)] if c in cols else []), fill))
    return out.drop("_touched")


#: What a new row's empty columns become: other columns, then the empty string. Fixed values.
DEFAULTS = {"person": {"english_name": [""]}, "bill": {"hebrew_name": ["title", ""]}, "office": {"hebrew_name": ["canonical_name", ""]}}


def stub_rows(facts: DataFrame, key: str, entities: DataFrame) -> DataFrame:
    """Keys that facts name and the entity table does not have, as rows without attributes."""
    missing = facts.select(key).where(F.col(key).isNotNull()).distinct().join(entities.select(key), key, "left_anti")
    return missing.select(*[F.col(c) if c == key else F.lit(None).cast(entities.schema[c].dataType).alias(c) for c in entities.columns])


def guarded(edges: DataFrame) -> DataFrame:
    """Edges whose properties are allowed: closed domains, and a start for terms."""
    for c, values in EDGE_DOMAINS.items():
        if c in edges.columns:
            edges = edges.where(F.col(c).isin(values))
    return edges.where(F.col("valid_from").isNotNull()) if "valid_from" in edges.columns else edges


def with_endpoints(edges: DataFrame, src: str, sources: DataFrame, dst: str, targets: DataFrame) -> DataFrame:
    """Edges whose two ends exist."""
    return edges.join(sources.select(src), src, "left_semi").join(targets.select(dst), dst, "left_semi")


def merge_edges(current: DataFrame | None, batch: DataFrame, src: str, dst: str, seq: str, mode: str = "terms", finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """mode "latest": one edge a pair, later properties overwrite, a null end keeps the old one.
    mode "terms": one edge for each (source, target, valid_from), so a second term does not overwrite the first.
    finish: applied to the folded batch. Without a current table the folded batch is the result.
    """
    keys = [src, dst, *(["valid_from"] if mode == "terms" and "valid_from" in batch.columns else [])]
    new = fold_batch(guarded(batch), keys, seq)
    new = finish(new) if finish else new
    if current is None:
        return new
    rest = [c for c in new.columns if c not in keys]
    both = current.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in rest]).join(new, keys, "full_outer")
    return both.select(*keys, *[F.coalesce(c, f"_o_{c}").alias(c) for c in rest])


@dataclass(frozen=True)
class AdapterRun:
    table: DataFrame  # after the upsert
    counts: DataFrame  # (stat, value)
    archived: DataFrame | None  # new archive rows, if pages were archived


def run_adapter(
    pages: DataFrame, parse: Callable[[DataFrame], DataFrame], normalise: Callable[[DataFrame], DataFrame], current: DataFrame, key: str, seq: str = "seq", archived: DataFrame | None = None, write: Callable[[DataFrame, DataFrame], DataFrame] | None = None
) -> AdapterRun:
    """A batch job: raw pages -> archive -> rows -> records -> table, with the run's counters.

    archived (content_sha256, archive_uri): pages (with ``content``, see ``archive``) that it does not hold become new archive
    rows. write(current, records): what is done with the records; a keyed upsert by default.
    """
    fresh = archive(pages, archived)[1] if archived is not None else None
    rows = parse(pages)
    records = normalise(rows)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("stat"), "value")
    counts = count(pages, "pages").unionByName(count(rows, "parsed")).unionByName(count(records, "upserted"))
    if fresh is not None:
        counts = counts.unionByName(count(fresh, "archived"))
    table = write(current, records) if write else upsert(current, records, key, seq)
    return AdapterRun(table, counts, fresh)
