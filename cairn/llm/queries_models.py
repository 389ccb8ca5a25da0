"""Queries with models that are trained here."""

from cairn.llm import languages, personal, toxicity
from cairn.llm.common import table
from cairn.llm.registry import query


@query("op1_personal_data")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return personal.digest(personal.personal_data(docs, personal.fit(docs)))


@query("op10_toxicity")
def op10(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_language_id")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return languages.languages(docs, languages.fit(docs))
