"""The queries of this subpackage, each over its whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from spindrift.llm import divergence, langid, lattice, maintext, mixing, orchard, pieces, pii, simhash, toxicity, urlrules, warc, winnow
from spindrift.llm.common import table


def op1_simhash(spark, sf_dir):
    return simhash.op1(table(spark, sf_dir, "documents"))


def op2_winnowing(spark, sf_dir):
    return winnow.op2(table(spark, sf_dir, "documents"))


def op3_langid(spark, sf_dir):
    return langid.op3(table(spark, sf_dir, "documents"))


def op4_mixing(spark, sf_dir):
    return mixing.op4(table(spark, sf_dir, "documents"))


def op5_pii(spark, sf_dir):
    return pii.op5(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_sentencepiece(spark, sf_dir):
    return pieces.op7(table(spark, sf_dir, "documents"))


def op8_lattice(spark, sf_dir):
    return lattice.op8(table(spark, sf_dir, "embeddings"))


def op9_warc(spark, sf_dir):
    return warc.op9(table(spark, sf_dir, "pages"))


def op10_urlrules(spark, sf_dir):
    return urlrules.op10(table(spark, sf_dir, "pages"))


def op11_orchard(spark, sf_dir):
    return orchard.op11(table(spark, sf_dir, "embeddings"))


def op12_divergence(spark, sf_dir):
    return divergence.op12(table(spark, sf_dir, "documents"))


def op13_maintext(spark, sf_dir):
    return maintext.op13(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_winnowing": op2_winnowing,
    "op3_langid": op3_langid,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_toxicity": op6_toxicity,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_lattice": op8_lattice,
    "op9_warc": op9_warc,
    "op10_urlrules": op10_urlrules,
    "op11_orchard": op11_orchard,
    "op12_divergence": op12_divergence,
    "op13_maintext": op13_maintext,
}
ORACLES: dict[str, str] = {
    "op9_warc": warc.ORACLE,
    "op10_urlrules": urlrules.ORACLE,
    "op11_orchard": orchard.ORACLE,
    "op12_divergence": divergence.ORACLE,
}
