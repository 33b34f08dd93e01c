"""A report put together from what stages left behind, where no synthesis was delivered."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from . import trees

# Standing texts by language, the keys under which open questions and objections stand.
STANDING = {
    "executive_summary": ("最终综合未完整生成。以下内容由已完成的研究阶段确定性整理。", "Final synthesis was incomplete. The content below deterministically preserves completed research stages."),
    "competitive_position": ("竞争地位尚待最终综合；请结合商业模式与信息缺口复核。", "Competitive position awaits final synthesis; review the business model and information gaps."),
    "thesis": ("尚未形成最终长期结论；可重试最终综合，阶段性结论已保留。", "No final long-term thesis was formed; retry synthesis while preserving stage conclusions."),
    "invalidation_conditions": ("尚待最终综合。", "Awaiting final synthesis."),
    "leading_indicators": ("尚待最终综合。", "Awaiting final synthesis."),
    "unresolved_questions": ("最终综合输出需要重新生成。", "The final synthesis output needs to be regenerated."),
}
OPEN = ["unknowns", "missing_evidence", "unresolved_questions"]
OBJECTIONS = ["unsupported_assumptions", "strongest_counterarguments"]
#: All sections in their order, and those that stages can give.
SECTIONS = [
    "executive_summary", "business_model", "financial_quality", "competitive_position", "growth_opportunities", "counterarguments",
    "scenarios", "thesis", "invalidation_conditions", "leading_indicators", "unresolved_questions", "claims",
]
GIVEN = [name for name in SECTIONS if name not in ("executive_summary", "thesis")]


def sections(business, financial, accounting, growth, skeptic, forecast) -> tuple[str | None, ...]:
    """The sections that the stages' trees give, in the order of GIVEN; null where a standing text is due."""
    member = lambda tree, name, otherwise: tree.get(name, otherwise) if isinstance(tree, dict) else otherwise
    listed = lambda tree, keys: trees.told(found) if (found := trees.strings_of(tree, keys)) else None
    shown = trees.without(business, trees.hidden_or_claims)
    moats = member(shown, "possible_moats", None)
    return (
        trees.told(shown),
        trees.told({"accounting_risk": trees.without(accounting, trees.hidden_or_claims), "financial_analysis": trees.without(financial, trees.hidden_or_claims)}),
        trees.told(moats) if moats else None,
        trees.told(member(growth, "opportunities", growth)),
        trees.told(member(skeptic, "strongest_counterarguments", skeptic)),
        trees.told(member(forecast, "scenarios", forecast)),
        listed(skeptic, OBJECTIONS),
        listed(growth, ["leading_indicators"]),
        listed([business, skeptic], OPEN),
        trees.told(trees.claims_of([business, financial, accounting, growth, skeptic, forecast])),
    )


def given(*stages: pa.Array) -> pa.Array:
    texts = zip(*(stage.to_numpy(zero_copy_only=False) for stage in stages), strict=True)
    made = [sections(*[trees.read(text, {}) for text in row]) for row in texts]
    columns = zip(*made, strict=True) if made else [()] * len(GIVEN)
    return pa.StructArray.from_arrays([pa.array(column, pa.string()) for column in columns], GIVEN)


def fallback_report(business: Column, financial: Column, accounting: Column, growth: Column, skeptic: Column, forecast: Column, language: Column) -> Column:
    """The twelve sections, each as JSON text with sorted keys, of the stages' JSON texts.

    A stage that is missing or no JSON counts as {}. Analyses come without private members and claims; lists that
    came out empty have a standing text in the language ("en", else Chinese); claims are those of all stages,
    the first of each text. Each stage's text is read once, all sections are made of it in one pass.
    """
    standing = lambda name: F.concat(F.lit('"'), F.when(language == "en", STANDING[name][1]).otherwise(STANDING[name][0]), F.lit('"'))
    made = arrow_udf(given, "struct<" + ",".join(f"{name}:string" for name in GIVEN) + ">")(business, financial, accounting, growth, skeptic, forecast)

    def section(name: str) -> Column:
        if name not in GIVEN:
            return standing(name)
        return F.coalesce(made[name], standing(name)) if name in STANDING else made[name]

    return F.struct(*[section(name).alias(name) for name in SECTIONS])
