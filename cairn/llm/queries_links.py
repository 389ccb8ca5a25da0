"""Queries over shared passages and near copies."""

from cairn.llm import decontamination, fingerprints, lexical, lines, url_rules
from cairn.llm.common import table
from cairn.llm.near_copies import near_copies
from cairn.llm.registry import query


@query("op8_decontamination", decontamination.SQL)
def op8(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


@query("op5_near_copies")
def op5(spark, sf_dir):
    return near_copies(table(spark, sf_dir, "documents"), size=2)


@query("op3_simhash")
def op3(spark, sf_dir):
    return fingerprints.with_edits(table(spark, sf_dir, "documents"))


@query("op2_url_rules", url_rules.SQL)
def op2(spark, sf_dir):
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, action string")
    return url_rules.judged(table(spark, sf_dir, "pages"), rules)


@query("op9_line_dedup")
def op9(spark, sf_dir):
    return lines.judged(table(spark, sf_dir, "documents"), shortest=1)


@query("op11_ranked_search", lexical.SQL)
def op11(spark, sf_dir):
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
