"""Narratives of single cases: anonymized payloads, prompts, template texts and their rubric."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessella.functions.scalar import percent, rounded

# The words that earn the higher mark on each axis of the rubric (any of them, for the last axis all), and
# the texts of the prompt and of the template.
RUBRIC = {
    "medical_precision": ("critérios", "clínic"),
    "cultural_sensitivity": ("saúde da mulher", "acolhedora", "sensível"),
    "language_adequacy": ("recomendações", "limites"),
}
ALL_NEEDED = ("language_adequacy",)
SOCIAL_CONTEXT = {
    "faixa_etaria": ("adulta jovem", "adulta"),
    "necessidade_linguagem": "clara, acolhedora e não alarmista",
    "confidencialidade": "não incluir identificadores diretos e evitar exposição desnecessária de dados",
}
YOUNG_BELOW, AGE_IF_UNKNOWN = 35, 30
PROMPT = """Você é um assistente clínico para saúde da mulher.

Contexto:
- Paciente anonimizada: {case_id}
- Probabilidade de PCOS prevista pelo modelo: {p}
- Predição binária do modelo (1=PCOS, 0=Não PCOS): {label}

Dados clínicos resumidos (anonimizados):
{features}

Principais features (contribuição local para a predição):
{top}

Contexto social e de comunicação:
{context}

Tarefas:
1) Explique a predição em linguagem natural para profissional de saúde.
2) Explique os fatores mais relevantes do caso.
3) Traga recomendações práticas e próximos passos clínicos sugeridos.
4) Inclua um aviso de confidencialidade e limitação do modelo.
5) Use linguagem sensível ao contexto de saúde da mulher.

Responda em português com 4 seções:
- Interpretação do caso
- Fatores relevantes
- Recomendações práticas
- Confidencialidade e limites"""
RISK = ("baixa a moderada", "elevada")
TEMPLATE = """Interpretação do caso:
- O modelo sugere probabilidade {p} de PCOS, com risco {risk}.

Fatores relevantes:
- Variáveis com maior contribuição local: {factors}.
- Esses sinais devem ser interpretados junto ao histórico clínico e exame físico.

Recomendações práticas:
- Confirmar critérios clínicos/laboratoriais e ultrassonográficos de PCOS.
- Revisar risco metabólico (glicemia, perfil lipídico, IMC, estilo de vida).
- Planejar seguimento com abordagem multiprofissional e educação em saúde.

Confidencialidade e limites:
- Esta interpretação usa dados anonimizados e não substitui decisão médica.
- O modelo pode errar; usar apenas como apoio à triagem e priorização."""


def filled(text: str, **values: Column) -> Column:
    """text with its names in braces replaced by columns; null where any of them is null."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[values[x].cast("string") if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def anonymize(df: DataFrame, identifiers: list[str]) -> DataFrame:
    """Without the identifying columns, names stripped, numbers as doubles."""
    rest = [f for f in df.schema.fields if f.name not in identifiers]
    number = lambda f: F.col(f"`{f.name}`").cast("double") if f.dataType.typeName() in ("integer", "long", "short", "float", "double", "decimal") else F.col(f"`{f.name}`")
    return df.select(*[number(f).alias(f.name.strip()) for f in rest])


def case_ids(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n first rows by key with case_id P_001, P_002, ..."""
    from pyspark.sql.window import Window

    first = df.orderBy(key).limit(n)
    return first.withColumn("case_id", F.format_string("P_%03d", F.row_number().over(Window.orderBy(key))))


def risk_band(p: Column) -> Column:
    return F.when(p >= 0.7, "high").when(p >= 0.4, "medium").otherwise("low")


def payload(*columns: str) -> Column:
    """The columns as a JSON object."""
    return F.to_json(F.struct(*columns))


def social_context(age: Column) -> Column:
    """The context of a person of an age, as JSON."""
    young = F.coalesce(age, F.lit(AGE_IF_UNKNOWN)) < YOUNG_BELOW
    band = F.when(young, SOCIAL_CONTEXT["faixa_etaria"][0]).otherwise(SOCIAL_CONTEXT["faixa_etaria"][1])
    return F.to_json(F.struct(*[(band if k == "faixa_etaria" else F.lit(v)).alias(k) for k, v in SOCIAL_CONTEXT.items()]))


def prompt(case_id: Column, p: Column, label: Column, features: Column, top: Column, age: Column) -> Column:
    """The prompt of a case; features and top are JSON."""
    return filled(PROMPT, case_id=case_id, p=F.format_string("%.3f", rounded(p, 3)), label=label, features=features, top=top, context=social_context(age))


def template_text(p: Column, label: Column, factors: Column) -> Column:
    """The text that stands in for a generated one; factors is an array of (feature, contribution)."""
    names = F.array_join(F.transform(factors, lambda f: F.concat(f["feature"], F.format_string(" (%+.2f)", F.round(f["contribution"].cast("decimal(18,6)"), 2).cast("double")))), ", ")
    return filled(TEMPLATE, p=percent(p), risk=F.when(label == 1, RISK[1]).otherwise(RISK[0]), factors=names)


def generate(texts: DataFrame, call: Callable[[str], str] | None = None) -> DataFrame:
    """Adds mode and response. Without `call`, a client of a text service that the caller brings, the template text stands;
    where it fails, the template text is marked. texts has the columns prompt and template."""
    if call is None:
        return texts.withColumn("mode", F.lit("local_fallback")).withColumn("response", F.col("template"))
    import pandas as pd

    def run(batches):
        for pdf in batches:
            out = []
            for text, template in zip(pdf["prompt"], pdf["template"], strict=True):
                try:
                    out.append(call(text))
                except Exception as e:
                    out.append(f"[fallback] {type(e).__name__}\n{template}")
            yield pd.concat([pdf, pd.DataFrame({"mode": "api", "response": out}, index=pdf.index)], axis=1)

    return texts.mapInPandas(run, StructType([*texts.schema.fields, StructField("mode", StringType()), StructField("response", StringType())]))


def rubric(df: DataFrame, text: str) -> DataFrame:
    """Adds a mark of 4 or 3 on each axis and `overall`, their mean rounded."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))

    def mark(axis: str, words: tuple[str, ...]) -> Column:
        tests = [F.contains(low, F.lit(w)) for w in words]
        return F.when(reduce(and_ if axis in ALL_NEEDED else or_, tests), 4).otherwise(3)

    marked = df.withColumns({axis: mark(axis, words) for axis, words in RUBRIC.items()})
    total = sum((F.col(a) for a in RUBRIC), F.lit(0))
    return marked.withColumn("overall", F.when(total >= 11, 4).otherwise(3))
