"""Validation and cleaning (V1-V8).

Raw documents are JSON text. Spark's VARIANT type (``try_parse_json``) gives
the top-level kind of a document and the kind of its ``player_id`` value, so
Python's truthiness and ``in`` rules are reproduced with Catalyst
expressions: no UDF.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.scalar import COLLECT_QUALITY, COLLECT_TIMESTAMP
from lodestar.functions.scalar import stamp as stamp_rows


def _kind(v: Column) -> Column:
    """Top-level JSON kind of a VARIANT: object, array, string, number, boolean, null."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None))
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("ARRAY"), "array")
        .when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "VOID", "null")
        .otherwise("number")
    )


def has_player_key(raw: Column | str) -> Column:
    """V1/V3 predicate: the document is a JSON object with key ``player_id``
    (a null value counts). NULL for non-objects and unparsable text."""
    r = F.col(raw) if isinstance(raw, str) else raw
    return F.array_contains(F.json_object_keys(r), "player_id")


def _id_text(v: Column) -> Column:
    return F.variant_get(v, "$.player_id", "string")


def collect_valid(raw: DataFrame, raw_col: str = "raw", quality: str = COLLECT_QUALITY,
                  stamp: str = COLLECT_TIMESTAMP) -> DataFrame:
    """V1: accepted documents -> (player_id, data_quality, timestamp).

    ``player_id`` is the text of the JSON value (NULL for JSON null)."""
    v = F.try_parse_json(F.col(raw_col))
    ok = F.coalesce(has_player_key(raw_col), F.lit(False))
    kept = raw.where(ok).select(*[c for c in raw.columns if c != raw_col], _id_text(v).alias("player_id"))
    return stamp_rows(kept, quality, stamp)


def rejection_reason(raw_col: str = "raw") -> Column:
    """V2: why a document is rejected, NULL when it is accepted.

    missing - NULL, a falsy value, an object without the key, an array or
              string not holding "player_id";
    error   - an array or string holding "player_id" (indexing it raises),
              a non-zero number or true (``in`` raises);
    malformed - text that is not JSON.
    """
    r = F.col(raw_col)
    v = F.try_parse_json(r)
    k = _kind(v)
    text = F.variant_get(v, "$", "string")
    arr_has = F.array_contains(F.from_json(F.when(k == "array", r), "array<string>"), "player_id")
    num_zero = F.variant_get(v, "$", "double") == 0
    return (
        F.when(r.isNull(), "missing")
        .when(v.isNull(), "malformed")
        .when(k == "object", F.when(~has_player_key(r), "missing"))
        .when(k == "array", F.when(F.coalesce(arr_has, F.lit(False)), "error").otherwise("missing"))
        .when(k == "string", F.when(F.instr(text, "player_id") > 0, "error").otherwise("missing"))
        .when(k == "boolean", F.when(text == "true", "error").otherwise("missing"))
        .when(k == "number", F.when(num_zero, "missing").otherwise("error"))
        .otherwise("missing")
    )


def collect_rejected(raw: DataFrame, raw_col: str = "raw") -> DataFrame:
    """V2: the rejected side with its reason."""
    return raw.withColumn("reason", rejection_reason(raw_col)).where(F.col("reason").isNotNull())


def admit(docs: DataFrame, raw_col: str = "raw") -> DataFrame:
    """V3: admission rule of the upsert (same predicate as V1); keeps the raw
    document and its player_id text."""
    v = F.try_parse_json(F.col(raw_col))
    return docs.where(F.coalesce(has_player_key(raw_col), F.lit(False))).withColumn("player_id", _id_text(v))


def id_is_hashable(raw_col: str = "raw") -> Column:
    """The ``player_id`` value can key a store (not a JSON array or object:
    such an id makes the upsert request fail, so nothing is stored)."""
    idv = F.variant_get(F.try_parse_json(F.col(raw_col)), "$.player_id", "variant")
    return F.coalesce(~_kind(idv).isin("array", "object"), F.lit(True))


def id_is_truthy(raw_col: str = "raw") -> Column:
    """V4 on documents: Python truthiness of the ``player_id`` value."""
    idv = F.variant_get(F.try_parse_json(F.col(raw_col)), "$.player_id", "variant")
    k = _kind(idv)
    text = F.variant_get(idv, "$", "string")
    return F.coalesce(
        F.when(k.isNull() | (k == "null"), False)
        .when(k == "number", F.variant_get(idv, "$", "double") != 0)
        .when(k == "string", text != "")
        .when(k == "boolean", text == "true")
        .when(k == "array", F.size(F.from_json(text, "array<string>")) > 0)
        .when(k == "object", F.size(F.json_object_keys(text)) > 0)
        .otherwise(True),
        F.lit(False),
    )


def require_truthy_id(df: DataFrame, col: str = "player_id", raw_col: str | None = None) -> DataFrame:
    """V4: keep rows whose player id is truthy (drops NULL, '' and 0)."""
    if raw_col is not None:
        return df.where(id_is_truthy(raw_col))
    c = F.col(col)
    kind = dict(df.dtypes)[col]
    if kind == "string":
        return df.where(c.isNotNull() & (c != ""))
    return df.where(c.isNotNull() & (c != 0))


def apply_history_defaults(history: DataFrame, raw_col: str | None = None) -> DataFrame:
    """V5: defaults for a *missing* key: duration 0, genre 'unknown',
    game_type 'singleplayer'.

    From JSON (``raw_col``): an explicit null genre stays NULL, an explicit
    null game_type stays NULL (ignored by the type counts) and an explicit
    null duration sets ``poison`` (the reference raises, so that player gets
    no profile). On tabular input there is no missing-vs-null: NULL means
    missing."""
    if raw_col is None:
        return history.select(
            *[c for c in history.columns if c not in ("genre", "duration", "game_type")],
            F.coalesce("genre", F.lit("unknown")).alias("genre"),
            F.coalesce("duration", F.lit(0.0)).cast("double").alias("duration"),
            F.coalesce("game_type", F.lit("singleplayer")).alias("game_type"),
            F.lit(False).alias("poison"),
        )
    # one parse per document: a JSON object as map<string,string> keeps a key
    # whose value is null (map_contains_key is true, the value NULL)
    m = F.from_json(F.col(raw_col), "map<string,string>")

    def field(name: str, default: Column) -> Column:
        return F.when(~F.map_contains_key(m, name), default).otherwise(m[name])

    return history.select(
        *[c for c in history.columns if c != raw_col],
        field("genre", F.lit("unknown")).alias("genre"),
        field("duration", F.lit("0")).cast("double").alias("duration"),
        field("game_type", F.lit("singleplayer")).alias("game_type"),
        (F.map_contains_key(m, "duration") & m["duration"].isNull()).alias("poison"),
    )


def clean(df: DataFrame, keys: list[str], order_by: list[str] | None = None,
          types: dict[str, str] | None = None) -> DataFrame:
    """V6: trim strings, empty -> NULL, cast to the target ``types`` (a value
    that does not parse becomes NULL), drop rows with a NULL key, and keep
    one row per key: the greatest by (``order_by``..., all other columns).

    The dedupe is an aggregation (``max_by`` of the row), so it combines
    map-side and a key with millions of copies never meets in one buffer.
    Columns that have no order (MAP, VARIANT) compare by their JSON text."""
    cleaned = df
    for name, kind in df.dtypes:
        if kind == "string":
            t = F.trim(F.col(name))
            cleaned = cleaned.withColumn(name, F.when(t != "", t))
    for name, kind in (types or {}).items():
        cleaned = cleaned.withColumn(name, F.col(name).try_cast(kind))
    for k in keys:
        cleaned = cleaned.where(F.col(k).isNotNull())
    order_by = list(order_by or [])
    rest = [c for c in df.columns if c not in keys and c not in order_by]
    kinds = dict(cleaned.dtypes)
    comparable = lambda c: F.to_json(F.col(c)) if re.search("map<|variant", kinds[c]) else F.col(c)
    rank = F.struct(*[comparable(c).alias(f"_r{i}") for i, c in enumerate(order_by + rest)], F.lit(0).alias("_end"))
    row = F.struct(*[F.col(c) for c in order_by + rest], F.lit(0).alias("_end"))
    best = cleaned.groupBy(*keys).agg(F.max_by(row, rank).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.`{c}`").alias(c) for c in order_by + rest]).select(*df.columns)


ID17_PATTERN = r"^[0-9]{17}$"


def resolve_ids(requests: DataFrame, aliases: DataFrame, col: str = "requested") -> DataFrame:
    """V7: a 17-digit numeric id passes through; otherwise the trimmed,
    lower-cased text is looked up in the alias table; unknown -> NULL.

    Only the name requests take part in the join (numeric ones would all
    carry a NULL key into one shuffle partition). Aliases are deduplicated
    per alias (smallest id) so one request yields one row."""
    numeric = F.col(col).rlike(ID17_PATTERN)
    ids = requests.where(numeric).select(
        *requests.columns, F.col(col).cast("long").alias("player_id"), F.lit("numeric_id").alias("resolved_by"))
    names = requests.where(~numeric | numeric.isNull()).withColumn("_alias", F.lower(F.trim(F.col(col))))
    amap = aliases.groupBy("alias").agg(F.min("player_id").alias("player_id"))
    j = names.join(amap, names["_alias"] == amap["alias"], "left")
    named = j.select(*requests.columns, "player_id",
                     F.when(F.col("player_id").isNotNull(), "alias").otherwise("unresolved").alias("resolved_by"))
    return ids.unionByName(named)


def upsert_players(current: DataFrame, updates: DataFrame, key: str = "player_id", seq: str = "seq") -> DataFrame:
    """V8: last write per key wins, whole document replaced.

    ``current`` rows rank below every update (seq = -inf side); among the
    updates the greatest ``seq`` wins. ``max_by`` is a partial aggregate, so a
    key with many updates is combined map-side."""
    cols = [c for c in updates.columns if c not in (key, seq)]
    cur = current.select(key, *cols).withColumn("_src", F.lit(0)).withColumn(seq, F.lit(None).cast("long"))
    upd = updates.select(key, *cols, seq).withColumn("_src", F.lit(1))
    both = cur.unionByName(upd)
    rank = F.struct(F.col("_src"), F.coalesce(F.col(seq), F.lit(-(2**63))).alias("s"))
    win = both.groupBy(key).agg(F.max_by(F.struct(*cols), rank).alias("_doc"))
    return win.select(key, *[F.col(f"_doc.{c}").alias(c) for c in cols])
