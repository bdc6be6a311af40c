"""Queries of the training-data operators, and their SQL where SQL can say it."""

from ..session import shared_dir
from . import (decontaminate, fingerprints, html_extract, langid, merkle, packing, quality, secret_scan, simhash,
               toxicity, url_filter, vector_codes, warc)
from .common import table


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_langid(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op3_urlfilter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op4_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"))


def op5_secrets(spark, sf_dir):
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_html(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_warc(spark, sf_dir):
    path = shared_dir(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.describe(warc.read_archive(spark, path))


def op10_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_vectorcodes(spark, sf_dir):
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


def op12_fingerprints(spark, sf_dir):
    return fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))


def op13_merkle(spark, sf_dir):
    return merkle.audit(table(spark, sf_dir, "documents"))


QUERIES = {q.__name__: q for q in (op1_simhash, op2_langid, op3_urlfilter, op4_quality, op5_secrets,
                                   op6_packing, op7_html, op8_toxicity, op9_warc, op10_decontaminate,
                                   op11_vectorcodes, op12_fingerprints, op13_merkle)}
ORACLES = {"op3_urlfilter": url_filter.ORACLE, "op11_vectorcodes": vector_codes.ORACLE, "op13_merkle": merkle.ORACLE}
