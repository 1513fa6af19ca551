"""Finding the text and label columns of unknown tables; flattening nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions import lexicon as lx
from folioscope.functions.labels import first_hit, map_label_company, map_label_standard
from folioscope.functions.patterns import let, strip
from folioscope.functions.text import clean_text_basic


def _string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def column_stats(df: DataFrame) -> DataFrame:
    """(position, column, mean_length, distinct_ratio, distincts) of the string columns, in one pass.

    Distinct counts run over 32-byte digests, so wide texts are not shuffled.
    """
    names = _string_columns(df)
    if not names:
        none = "position int, column string, mean_length double, distinct_ratio double, distincts bigint"
        return df.sparkSession.createDataFrame([], none)
    digest = lambda c: F.unhex(F.sha2(F.col(c), 256))
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        # a missing text is measured as the three letters a missing value prints as
        *[F.avg(F.length(F.coalesce(F.col(c), F.lit("nan")))).alias(f"len_{i}") for i, c in enumerate(names)],
        *[F.count_distinct(digest(c)).alias(f"dis_{i}") for i, c in enumerate(names)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.col(f"len_{i}").alias("mean_length"),
                F.try_divide(F.col(f"dis_{i}"), F.col("n")).alias("distinct_ratio"),
                F.col(f"dis_{i}").alias("distincts"),
            )
            for i, c in enumerate(names)
        ]
    )
    return stats.select(F.inline(rows))


def detect_text_column(df: DataFrame, stats: DataFrame | None = None) -> str | None:
    """A column with a usual text name, else the string column with the longest values."""
    named = [c for c in lx.TEXT_COLUMNS if c in df.columns]
    if named or not _string_columns(df):
        return named[0] if named else None
    stats = column_stats(df) if stats is None else stats
    top = stats.orderBy(F.desc("mean_length"), "position").first()
    return top["column"] if top and top["mean_length"] else None


def detect_label_column(df: DataFrame, stats: DataFrame | None = None, any_size: bool = False) -> str | None:
    """A column with a usual label name, else the first string column other than the text
    whose distinct share lies in [0.01, 0.5].

    A class column's share falls as a table grows. With ``any_size``, where no column fits, the first with two
    values or more and a share of at most 0.5 is taken.
    """
    named = [c for c in lx.LABEL_FIELDS if c in df.columns]
    if named or not _string_columns(df):
        return named[0] if named else None
    stats = (column_stats(df) if stats is None else stats).collect()  # one row per column
    text = [c for c in lx.TEXT_COLUMNS if c in df.columns]
    longest = max(stats, key=lambda r: (r.mean_length or 0.0, -r.position)).column
    chosen = text[0] if text else longest
    others = [r for r in stats if r.column != chosen and (r.distinct_ratio or 0) <= 0.5]
    fits = [r.column for r in others if (r.distinct_ratio or 0) >= 0.01]
    if any_size and not fits:
        fits = [r.column for r in others if r.distincts >= 2]
    return fits[0] if fits else None


def coalesce_text(df: DataFrame) -> Column:
    """First non-empty of the usual text fields, else all longer string fields joined."""
    present = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in lx.TEXT_FIELDS if c in df.columns]
    longer = F.array_join(
        F.filter(F.array(*[F.col(c) for c in _string_columns(df)]), lambda v: F.length(v) > 10), " "
    )
    return F.coalesce(*present, longer)


def coalesce_label(df: DataFrame) -> Column:
    present = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in lx.LABEL_FIELDS if c in df.columns]
    return F.coalesce(*present, F.lit("document"))


def records_to_corpus(df: DataFrame, text: Column, label: Column, source: str, min_length: int = 20) -> DataFrame:
    """(text, label, source) of records whose text is longer than ``min_length``."""
    return (
        df.select(text.alias("text"), label.alias("label"))
        .filter(F.length("text") > min_length)
        .select(
            clean_text_basic(F.col("text")).alias("text"),
            map_label_standard(F.col("label")).alias("label"),
            F.lit(source).alias("source"),
        )
    )


def profile_schema(df: DataFrame) -> DataFrame:
    """(position, column, type, n_rows, sample): the sample is one record as JSON."""
    columns = F.array(
        *[
            F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"))
            for i, f in enumerate(df.schema)
        ]
    )
    totals = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.first(F.to_json(F.struct(*df.columns))).alias("sample"),
    )
    return totals.select(F.inline(columns), "n_rows", "sample")


def flatten_company_record(df: DataFrame, min_length: int = 20) -> DataFrame:
    """(text, label, original_label, filename) from nested company records.

    Text: ``file_content``, else the extracted data's text or content, else the chat messages
    joined by blanks. Label: ``document_type`` or the file-name part before the extension (for
    file names with a dot), else a guess by file name.
    """
    def text_of(name: str) -> Column:
        return F.nullif(F.col(name), F.lit(""))

    options = []
    if "file_content" in df.columns:
        options.append(text_of("file_content"))
    kinds = {f.name: f.dataType for f in df.schema}
    if "extracted_data" in kinds:
        if isinstance(kinds["extracted_data"], T.StructType):
            options += [text_of(f"extracted_data.{f}") for f in ("text", "content") if f in kinds["extracted_data"].names]
        else:
            options.append(text_of("extracted_data"))
    if "chat_format" in kinds:
        if isinstance(kinds["chat_format"], T.ArrayType):
            options.append(
                F.nullif(
                    F.concat_ws("", F.transform("chat_format", lambda m: F.concat(m["content"], F.lit(" ")))),
                    F.lit(""),
                )
            )
        else:
            options.append(text_of("chat_format"))
    file_name = F.coalesce(F.col("file_name"), F.lit("")) if "file_name" in kinds else F.lit("")
    stated = F.col("document_type") if "document_type" in kinds else F.lit(None).cast("string")
    before_extension = F.element_at(F.split(file_name, r"\."), -2)
    named = F.when(
        file_name.contains("."), F.coalesce(F.nullif(stated, F.lit("")), F.nullif(before_extension, F.lit("")))
    )
    guessed = let(F.lower(file_name), lambda n: F.coalesce(first_hit(n, lx.COMPANY_FILE_NAME_WORDS), F.lit("document")))
    picked = df.select(
        F.coalesce(*options).alias("text"),
        F.coalesce(named, guessed).alias("original_label"),
        file_name.alias("filename"),
    )
    return picked.filter(F.length("text") > min_length).select(
        strip(F.col("text")).alias("text"),
        map_label_company(F.col("original_label")).alias("label"),
        "original_label",
        "filename",
    )


def prune_sparse_columns(
    df: DataFrame,
    essential: tuple[str, ...] = ("text", "label"),
    optional: tuple[str, ...] = ("source", "word_count", "original_label"),
    max_missing: float = 50.0,
) -> DataFrame:
    """Essential columns and those optional ones with less than half of their values missing."""
    present = [c for c in optional if c in df.columns]
    kept = []
    if present:
        row = df.agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(F.col(c).isNull()).alias(f"m_{i}") for i, c in enumerate(present)],
        ).first()
        kept = [c for i, c in enumerate(present) if row["n"] and row[f"m_{i}"] / row["n"] * 100 < max_missing]
    return df.select(*essential, *kept)


def response_projection(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Adds the extracted date, client name and address to a result row."""
    named = {"date": "extracted_date", "client_name": "client_name", "client_address": "client_address"}
    return df.withColumns({out: fields[name] for name, out in named.items() if name in fields})
