"""Queries over token ids."""

from cairn.llm import pieces, prefixes
from cairn.llm.common import table
from cairn.llm.packing import pack_documents
from cairn.llm.registry import query
from cairn.llm.token_files import read_token_files, write_token_files
from cairn.session import Stages


@query("op6_best_fit_packing")
def op6(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"))


@query("op7_token_files")
def op7(spark, sf_dir):
    out = f"{Stages(spark).root}/tokens"
    write_token_files(table(spark, sf_dir, "documents"), out)
    return read_token_files(spark, out)


@query("op13_sentencepiece")
def op13(spark, sf_dir):
    return pieces.digest(pieces.decoded(pieces.encoded(table(spark, sf_dir, "documents"))))


@query("op12_prefix_trie", prefixes.SQL)
def op12(spark, sf_dir):
    return prefixes.trie(table(spark, sf_dir, "conversations"))
