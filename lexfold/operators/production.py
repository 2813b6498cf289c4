"""Privilege, redaction and production sets: dispositions, quality control, numbering, load-file rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexfold.functions.normalize import bates, file_type_of
from lexfold.operators.ranks import running

# Fixed values.
DISPOSITIONS = ("withhold", "redact_in_part", "produce")
PAGE_ERROR = "page_num must be between 1 and "
X_ERROR, Y_ERROR = "x_pct must be between 0 and 100", "y_pct must be between 0 and 100"
EXTENT_ERROR = "w_pct and h_pct must be greater than 0"
RIGHT_ERROR, BOTTOM_ERROR = "x_pct + w_pct must not exceed 100", "y_pct + h_pct must not exceed 100"


def effective_disposition(privileged: Column, redacted: Column, override: Column) -> Column:
    """A valid override, else what redactions or a privilege tag ask for; null is an ordinary production."""
    return F.when(override.isin(*DISPOSITIONS), override).when(redacted, "redact_in_part").when(privileged, "withhold")


def qc_status(redactions: Column, decision: Column, decided_at: Column, count_then: Column, changed_at: Column) -> Column:
    """A decision holds while the redactions it saw are unchanged in number and time."""
    stale = (count_then != redactions) | F.coalesce(changed_at >= decided_at, F.lit(False))
    return F.when(redactions == 0, "not_applicable").when(decision.isNull() | stale, "pending").otherwise(decision)


def log_description(sender: Column, recipient: Column, date: Column, file_type: Column, basis: Column, disposition: Column, manual: Column) -> Column:
    """A sentence from metadata alone (never from text, summary or title); a manual one stands as it is."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    kind = F.when(given(sender) | given(recipient), "Email").when(given(file_type), F.concat(F.upper(file_type), F.lit(" document"))).otherwise("Document")
    phrase = F.when(disposition == "withhold", "withheld").when(disposition == "redact_in_part", "produced in redacted form")
    parts = F.concat_ws(
        " ",
        kind,
        F.when(given(sender), F.concat(F.lit("from "), sender)),
        F.when(given(recipient), F.concat(F.lit("to "), recipient)),
        F.when(date.isNotNull(), F.concat(F.lit("dated "), F.date_format(date, "yyyy-MM-dd"))),
        phrase,
        F.when(F.size(basis) > 0, F.concat(F.lit("on the basis of "), F.array_join(basis, ", "))),
    )
    return F.when(given(manual), manual).otherwise(F.concat(parts, F.lit(".")))


def rectangle_error(page: Column, x: Column, y: Column, w: Column, h: Column, pages: Column) -> Column:
    """The first thing wrong with a redaction in percent of its page; null when it is valid."""
    return (
        F.when((page < 1) | (page > pages), F.concat(F.lit(PAGE_ERROR), pages.cast("string")))
        .when((x < 0) | (x > 100), X_ERROR)
        .when((y < 0) | (y > 100), Y_ERROR)
        .when((w <= 0) | (h <= 0), EXTENT_ERROR)
        .when(x + w > 100, RIGHT_ERROR)
        .when(y + h > 100, BOTTOM_ERROR)
    )


def produced_as_native(disposition: Column, native_path: Column, types: tuple[str, ...]) -> Column:
    """Whether a document that is produced whole goes out as its native file: it has one, of a type that the set asks for."""
    kind = F.coalesce(file_type_of(native_path).isin(*types), F.lit(False)) if types else F.lit(False)
    return (F.coalesce(disposition, F.lit("produce")) == "produce") & native_path.isNotNull() & kind


def produced_pages(disposition: Column, pages: Column, native: Column | None = None) -> Column:
    """A document that is withheld or produced as its native file takes one page, its slip sheet."""
    slip = (disposition == "withhold") if native is None else F.coalesce(disposition == "withhold", F.lit(False)) | native
    return F.when(slip, F.lit(1)).otherwise(F.greatest(pages, F.lit(1))).cast("bigint")


def ordered(members: DataFrame, by_custodian: bool = False) -> DataFrame:
    """members with sort_order per set: families stay together, in the order of their first member.

    members: set_id, control, family_id, custodian, doc_date and others. Orders of a set are one sequence, ranked in parts.
    """
    family = F.coalesce(F.concat(F.lit("f"), F.col("family_id").cast("string")), F.concat(F.lit("s"), "control"))
    head = Window.partitionBy("set_id", "_family").orderBy("control")
    first = lambda c: F.first(c).over(head)
    m = members.withColumn("_family", family).withColumn("_control", first("control")).withColumn("_custodian", F.coalesce(first("custodian"), F.lit(""))).withColumn("_date", first("doc_date"))
    keys = [F.col("_custodian"), F.col("_date").isNotNull().cast("int").desc(), F.col("_date").asc_nulls_last()] if by_custodian else []
    return running(m, ["set_id"], [*keys, "_control", "control"], "sort_order").drop("_family", "_control", "_custodian", "_date")


def numbered(members: DataFrame, prefix: str, padding: int, start: int) -> DataFrame:
    """members (set_id, sort_order, pages) with begin and end: gap-free numbers in order."""
    number = lambda c: bates(F.lit(prefix), c, F.lit(padding))
    summed = running(members, ["set_id"], ["sort_order"], "_last", F.col("pages")).withColumn("_last", F.col("_last") + F.lit(start - 1))
    return summed.withColumn("begin", number(F.col("_last") - F.col("pages") + 1)).withColumn("end", number(F.col("_last"))).drop("_last")


def set_members(docs: DataFrame, explicit: DataFrame, tagged: DataFrame, duplicates: DataFrame, existing: DataFrame) -> DataFrame:
    """doc_id to add to a set: explicit and tagged documents and their families, without received ones and without
    copies other than the lowest-numbered of each group (explicit ones stay), without those already there.

    docs: doc_id, family_id, source_type, bates_begin; duplicates: doc_id, group_id.
    """
    wanted = explicit.select("doc_id").union(tagged.select("doc_id")).distinct()
    families = docs.join(wanted, "doc_id", "left_semi").filter("family_id IS NOT NULL").select("family_id").distinct()
    all_ = wanted.union(docs.join(families, "family_id", "left_semi").select("doc_id")).distinct()
    received = docs.filter("source_type = 'received'").select("doc_id")
    grouped = duplicates.join(docs.select("doc_id", "bates_begin"), "doc_id")
    copies = grouped.withColumn("r", F.row_number().over(Window.partitionBy("group_id").orderBy("bates_begin", "doc_id"))).filter("r > 1").select("doc_id")
    drop = received.union(copies).distinct().join(explicit.select("doc_id"), "doc_id", "left_anti")
    return all_.join(drop, "doc_id", "left_anti").join(existing.select("doc_id"), "doc_id", "left_anti")
