"""Problem 2: records that differ only in white space, case, punctuation or order of labelled fields.

Each text gets a canonical key (``canonical_key``); rows of equal key are copies of the row with the smallest id.
Aggregation: exact counts by key (map-side partial counts) find the hot keys; hot keys are salted and aggregated on two
levels, all others by one shuffle. A hot key has at least ``1 / HOT_SHARE`` of all rows, so there are at most
``HOT_SHARE`` of them, which bounds the one broadcast.

Results for the special cases: null texts are no records; empty and blank texts share one key; rows with the same id
and key count as one record each row; extra columns are ignored; an empty table gives no rows. Ties cannot arise, as the
representative is the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: White space that formatting may change. Other space characters are look-alikes (problem 6).
SPACE = "[ \\t\\r\\n\\u000b\\f\\u3000]+"
#: Marks between a label and its value.
SEPARATOR = "[：:・…/／＝=]+|[-－—―]+"
#: A label: a short word without figures and marks.
LABEL = "[^\\s\\d：:；;，,、。．・…/／＝=「」『』（）()\\-－—―]{1,8}"
#: A label is learned if it has at least this share of all labels found; so there are at most 1 / share.
LABEL_SHARE = 0.005
HOT_SHARE = 1000
SALTS = 64


def squeeze(c: Column) -> Column:
    """Lower case without punctuation; a decimal point and a minus sign stay as part of their number."""
    c = F.lower(c)
    c = F.regexp_replace(c, "(\\p{P})\\1+", "$1")
    c = F.regexp_replace(c, "(?<=[0-9０-９])[.．](?=[0-9０-９])", "\u0001")
    c = F.regexp_replace(c, "(?<![\\p{IsLatin}\\p{N}%℃\\u0001])[-－−](?=[0-9０-９])", "\u0002")
    return F.regexp_replace(c, "[\\p{P}&&[^%％‰]]+", "")


def learn_labels(texts: DataFrame, text_col: str = "text", share: float = LABEL_SHARE) -> list[str]:
    """Field labels of the corpus: short words before a colon at the start of a field, by their share of all such words."""
    pattern = "(?:^|[；;，,、\\n\\t])[ \\u3000]*([^\\s\\d：:；;，,、。．・…/「」『』（）()\\-]{1,8})[：:]"
    words = texts.where(F.col(text_col).rlike("[：:]")).select(F.explode(F.expr(f"regexp_extract_all(`{text_col}`, '{pattern}', 1)".replace("\\", "\\\\"))).alias("w"))
    counts = cut(words.groupBy("w").count())
    total = counts.agg(F.sum("count")).first()[0] or 0
    kept = counts.where(F.col("count") >= max(2, total * share)).collect()  # at most 1 / share words
    return sorted((r.w for r in kept), key=lambda w: (-len(w), w))


def _own_fields(text: Column) -> Column:
    """The label and value of each field of a text that is a form by its own structure, whatever its labels, sorted; else null."""
    pieces = F.filter(F.split(text, "[；;，,、\\n\\t]+"), lambda x: F.trim(F.regexp_replace(x, SPACE, "")) != "")
    flat = F.transform(pieces, lambda x: F.regexp_replace(x, SPACE, ""))
    is_field = f"^{LABEL}(?:{SEPARATOR})[^：:]+$"
    value = lambda x: F.concat(F.regexp_extract(x, f"^({LABEL})", 1), F.lit("\u0003"), squeeze(F.regexp_replace(x, f"^{LABEL}(?:{SEPARATOR})", "")))
    return F.when((F.size(flat) >= 2) & F.forall(flat, lambda x: x.rlike(is_field)), F.array_join(F.array_sort(F.transform(flat, value)), "\u0004"))


def canonical_key(text: Column, labels: list[str]) -> Column:
    """The text without formatting; a form's fields are sorted. Null stays null.

    Fields are found by the corpus's frequent ``labels``, also where nothing but these marks their beginning; a text in which
    none of them stands twice is a form too if all its parts are a label, a separator and a value.
    """
    flat = F.regexp_replace(text, SPACE, "")
    own = F.when(text.rlike("[；;，,、\\n\\t]") & text.rlike(f"(?:{SEPARATOR})"), _own_fields(text))
    plain = F.coalesce(F.concat(F.lit("\u0005"), own), squeeze(flat))
    if not labels:
        return plain
    names = "|".join(f"\\Q{w}\\E" for w in labels)
    fields = F.split(flat, f"(?=(?:{names})(?:{SEPARATOR}))")
    is_field = f"^(?:{names})(?:{SEPARATOR})"
    value = lambda x: F.concat(F.regexp_extract(x, f"^({names})", 1), F.lit("\u0003"), squeeze(F.regexp_replace(x, is_field, "")))
    head = F.array_join(F.filter(fields, lambda x: ~x.rlike(is_field)), "")
    body = F.array_join(F.array_sort(F.transform(F.filter(fields, lambda x: x.rlike(is_field)), value)), "\u0004")
    count = F.size(F.filter(fields, lambda x: x.rlike(is_field)))
    may_be_form = flat.rlike(f"(?:{names})(?:{SEPARATOR}).*(?:{names})(?:{SEPARATOR})")
    return F.when(may_be_form & (count >= 2), F.concat(squeeze(head), F.lit("\u0005"), body)).otherwise(plain)


def keyed_rows(df: DataFrame, id_col: str, text_col: str, labels: list[str]) -> DataFrame:
    """row_id and the 128-bit digest of the canonical key; null texts are left out."""
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("row_id"), canonical_key(F.col(text_col), labels).alias("_k"))
    return rows.select("row_id", F.unhex(F.md5(F.col("_k").cast("binary"))).alias("key"))


def hot_keys(rows: DataFrame, keys: list[str], n_rows: int, share: int = HOT_SHARE) -> DataFrame:
    """Keys with at least 1/share of all rows, at most ``share`` of them; exact, from partial counts."""
    return rows.groupBy(*keys).count().where(F.col("count") >= max(2, n_rows / share)).select(*keys)


def collapse(rows: DataFrame, keys: list[str], id_col: str = "row_id", share: int = HOT_SHARE, salts: int = SALTS) -> DataFrame:
    """One record for each key: ``keys``, keep_id, n_copies. Hot keys go through salted two-level aggregation.

    ``rows`` is read three times (number, hot keys, aggregation), so it should be a table or a checkpoint.
    """
    hot = F.broadcast(hot_keys(rows, keys, rows.count(), share).withColumn("_hot", F.lit(True)))
    marked = rows.join(hot, keys, "left")
    salted = marked.where("_hot").groupBy(*keys, F.pmod(F.xxhash64(id_col), F.lit(salts)).alias("_salt")).agg(F.min(id_col).alias("keep_id"), F.count("*").alias("n_copies"))
    of_hot = salted.groupBy(*keys).agg(F.min("keep_id").alias("keep_id"), F.sum("n_copies").alias("n_copies")).withColumn("_hot", F.lit(True))
    of_rest = marked.where("_hot is null").groupBy(*keys).agg(F.min(id_col).alias("keep_id"), F.count("*").alias("n_copies")).withColumn("_hot", F.lit(False))
    return of_hot.unionByName(of_rest)


def surplus(rows: DataFrame, records: DataFrame, keys: list[str], id_col: str = "row_id") -> DataFrame:
    """Every row that is not its record's representative, with keep_id. Hot records are joined by broadcast (at most ``HOT_SHARE`` rows)."""
    several = records.where("n_copies > 1").drop("n_copies")
    hot = F.broadcast(several.where("_hot").drop("_hot").withColumnRenamed("keep_id", "_hot_keep"))
    cold = several.where("not _hot").drop("_hot")
    marked = rows.join(hot, keys, "left")
    of_hot = marked.where("_hot_keep is not null").withColumnRenamed("_hot_keep", "keep_id")
    of_cold = marked.where("_hot_keep is null").drop("_hot_keep").join(cold, keys)
    return of_hot.unionByName(of_cold.select(of_hot.columns)).where(F.col(id_col) != F.col("keep_id"))
