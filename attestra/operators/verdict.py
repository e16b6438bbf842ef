"""The verdict on a recorded value, by an ordered cascade of rules.

OK needs two independent pieces of evidence: the text readings, and a template reading that owes nothing to them. The
value itself is compared last, so that nothing before depends on the answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra import constants as K
from attestra.functions.text import complete, contradicts, one_based, unread_positions

VERDICTS = ("OK", "NG", "CHECK", "NOTEXT")


def verdict(
    value: Column,
    ocr: Column,
    ocr2: Column,
    pdf_text: Column,
    score: Column,
    shape: Column,
    template: Column,
    conflict: Column,
    why: Column,
    early: Column,
) -> Column:
    """struct<verdict, reason_code, reason, text_conflict>; the first rule that holds decides.

    pdf_text null: no text layer, and the rule is skipped. why: the template reading doesn't apply. early: a reason
    found before reading (then the row is CHECK for it). conflict: places where two resolutions differ.
    """
    blank = F.lit("")
    tx, again = F.coalesce(ocr, blank), F.coalesce(ocr2, blank)
    sh, tp = F.coalesce(shape, blank), F.coalesce(template, blank)
    sh_ok, tp_ok = complete(sh), complete(tp)
    why = F.when(why != "", why)
    some_conflict = F.size(F.coalesce(conflict, F.array().cast("array<int>"))) > 0
    apart = (sh_ok & (sh != tx)) | (tp_ok & (tp != tx)) | (sh_ok & tp_ok & (sh != tp))
    low = F.coalesce(score, F.lit(0.0)) < K.MIN_SCORE
    text = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    rule = lambda kind, code, reason, clash=False: F.struct(F.lit(kind).alias("verdict"), F.lit(code).alias("reason_code"), reason.alias("reason"), F.lit(clash).alias("text_conflict"))
    noted = lambda code, reason, clash=False: rule("CHECK", code, F.when(why.isNotNull() & ~reason.contains(F.coalesce(why, blank)), text(reason, " (template not applicable: ", why, ")")).otherwise(reason), clash)
    agreed = F.concat_ws("+", F.lit("readings"), F.when(sh_ok, F.lit("shapes")), F.lit("template"))
    weak = F.when(low, "; low score, but the template agrees").otherwise("")
    return (
        F.when(F.coalesce(early, blank) != "", noted("early", early))
        .when(tx == "", rule("NOTEXT", "no-text", F.when(why.isNotNull(), text("no text found (template not applicable: ", why, ")")).otherwise(F.lit("no text found"))))
        .when(again == "", noted("second-empty", F.lit("the second reading is empty")))
        .when(pdf_text != tx, noted("text-layer", text("the text layer differs: ", pdf_text, " / ", tx)))
        .when(again != tx, noted("readings-differ", text("two readings differ: ", tx, " / ", again)))
        .when(some_conflict, noted("resolutions-differ", text("template readings of two resolutions differ at ", one_based(conflict)), True))
        .when(contradicts(sh, tx), noted("partial-shape-conflict", text("shapes contradict the text: ", sh), True))
        .when(contradicts(tp, tx), noted("partial-template-conflict", text("the template contradicts the text: ", tp), True))
        .when(apart, noted("tracks-differ", text("readings differ: ", F.concat_ws(", ", tx, F.when(sh_ok, sh), F.when(tp_ok, tp))), True))
        .when(~sh_ok & ~tp_ok, noted("single-track", F.lit("text readings only")))
        .when(low & ~tp_ok, noted("low-score", F.lit("low score without other evidence")))
        .when(~tp_ok & why.isNotNull(), noted("template-not-applicable", text("template not applicable: ", why)))
        .when(~tp_ok & tp.contains("?"), noted("template-unread", text("template unread at ", one_based(unread_positions(tp)))))
        .when(~tp_ok, noted("template-incomplete", F.lit("template incomplete")))
        .when(tx == value, rule("OK", "match", text(agreed, " agree", weak)))
        .otherwise(rule("NG", "differs-from-value", text(agreed, " agree, but not with the value", weak)))
    )


def judge(rows: DataFrame) -> DataFrame:
    """rows (value, ocr, ocr2, pdf_text, score, shape, template, conflict, why, early) with verdict, reason_code, reason
    and text_conflict."""
    names = ("value", "ocr", "ocr2", "pdf_text", "score", "shape", "template", "conflict", "why", "early")
    return rows.withColumn("_v", verdict(*(F.col(n) for n in names))).select("*", "_v.*").drop("_v")
