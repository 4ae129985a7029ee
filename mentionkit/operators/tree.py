"""Dependency-tree operators: J6 (parent), J7 (children), F1-F3, P14.

A tree lives inside a sentence, so the words of each sentence are gathered into one array (one
aggregate on ``(doc_id, sent)``, bounded by a sentence) and each target is joined to the array of its
own sentence; everything else is row-local. Parent pointers are 1-based positions in the sentence:
the parent of word ``wi`` is the word ``wi + governor - idx`` (J6) and its children are the words
whose ``governor`` equals its ``idx`` (J7). The bag needs at most two steps up and two down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mentionkit import schema as S
from mentionkit.functions import columns as C
from mentionkit.operators.windows import positional_window


def with_sentence(targets: DataFrame, words: DataFrame, kind: str = "UPOS") -> DataFrame:
    """``(id, role, doc_id, wi, sent, ws, me)``: each target with its sentence's words and its own one.

    Targets without a word in ``words`` drop out.
    """
    node = F.struct("wi", "idx", "governor", "deprel", "upos", "xpos", C.tag_of(kind).alias("tag"))
    place = targets.select("id", "role", "doc_id", "wi").join(words.select("doc_id", "wi", "sent"), ["doc_id", "wi"])
    sentences = words.groupBy("doc_id", "sent").agg(F.collect_list(node).alias("ws"))
    return place.join(sentences, ["doc_id", "sent"]).withColumn("me", _at("ws", F.col("wi")))


def _at(ws: str, wi: Column) -> Column:
    """The word of the sentence at place ``wi``; NULL when there is none."""
    return F.get(F.filter(ws, lambda x: x["wi"] == wi), 0)


def _parent(ws: str, node: Column) -> Column:
    """The governor of ``node``; NULL at the root."""
    return F.when(node["governor"] != 0, _at(ws, node["wi"] + node["governor"] - node["idx"]))


def _children(ws: str, node: Column) -> Column:
    """The words governed by ``node``; none where that is NULL."""
    return F.filter(ws, lambda x: F.coalesce(x["governor"] == node["idx"], F.lit(False)))


def dependency_bag(targets: DataFrame, words: DataFrame, kind: str = "UPOS") -> DataFrame:
    """``(id, role, relation, tag)`` -- governor, ancestor, sibling, sibling_child, child, grandchild."""
    t = with_sentence(targets, words, kind)
    t = t.withColumn("par", _parent("ws", F.col("me")))
    t = t.withColumn("anc", _parent("ws", F.col("par"))).withColumn("kids", _children("ws", F.col("me")))
    t = t.withColumn("sibs", F.filter(_children("ws", F.col("par")), lambda x: x["wi"] != F.col("wi")))

    def tagged(relation: str, nodes: Column) -> Column:
        return F.transform(nodes, lambda x: F.struct(F.lit(relation).alias("relation"), x["tag"].alias("tag")))

    def below(nodes: str) -> Column:
        return F.flatten(F.transform(nodes, lambda c: F.filter("ws", lambda x: x["governor"] == c["idx"])))

    def one(relation: str, there: Column, tag: Column) -> Column:
        rows = F.array(F.struct(F.lit(relation).alias("relation"), tag.alias("tag")))
        return F.when(there, rows).otherwise(F.slice(rows, 1, 0))

    # the governor's governor; NONE when it lies beyond the sentence
    beyond = F.coalesce(F.col("anc.tag"), F.lit(S.NONE_TAG))
    rows = F.concat(
        one("governor", F.col("par").isNotNull(), F.col("par.tag")),
        one("ancestor", F.coalesce(F.col("par.governor") != 0, F.lit(False)), beyond),
        tagged("child", F.col("kids")), tagged("sibling", F.col("sibs")),
        tagged("grandchild", below("kids")), tagged("sibling_child", below("sibs")))
    return t.select("id", "role", F.explode(rows).alias("r")).select("id", "role", "r.relation", "r.tag")


def target_nodes(targets: DataFrame, words: DataFrame) -> DataFrame:
    """Per target: its deprel, xpos, sentence and its governor's deprel / upos (J6, NULL when none)."""
    t = with_sentence(targets, words).withColumn("par", _parent("ws", F.col("me")))
    return t.select("id", "role", "doc_id", "wi", "sent", "me.idx", "me.governor", "me.deprel", "me.xpos", "me.upos",
                    F.col("par.deprel").alias("g_deprel"), F.col("par.upos").alias("g_upos"))


def _pivot(nodes: DataFrame, cols: list[str]) -> DataFrame:
    return nodes.groupBy("id").agg(
        *[F.max(F.when(F.col("role") == r, F.col(c))).alias(f"{r.lower()}_{c}")
          for r in ("P", "A", "B") for c in cols])


def bag_overlap(bags: DataFrame) -> DataFrame:
    """``|set(P) & set(C)|`` per (id, cand) over ``(id, role, feature)`` bags of a few entries each."""
    sets = bags.groupBy("id").agg(*[F.collect_set(F.when(F.col("role") == r, F.col("feature"))).alias(r)
                                    for r in ("P", "A", "B")])
    each = sets.select("id", F.explode(F.array(*[
        F.struct(F.lit(r).alias("cand"), F.size(r).alias("n"), F.size(F.array_intersect("P", r)).alias("overlap"))
        for r in ("A", "B")])).alias("c"))
    return each.where("c.n > 0").select("id", "c.cand", F.col("c.overlap").cast("long").alias("overlap"))


def relational_features(targets: DataFrame, words: DataFrame, kind: str = "UPOS",
                        window: int = S.DEFAULT_WINDOW) -> DataFrame:
    """eleven pronoun-vs-candidate features per mention."""
    nd = target_nodes(targets, words).select(
        "id", "role", "wi", "xpos", C.deprel_head("deprel").alias("dep"),
        F.coalesce(C.deprel_head("g_deprel"), F.lit("")).alias("gdep"),
        F.coalesce("g_upos", F.lit("")).alias("gupos"))
    piv = _pivot(nd, ["wi", "xpos", "dep", "gdep", "gupos"])
    ov = bag_overlap(positional_window(targets, words, window, kind))
    ovp = ov.groupBy("id").agg(
        F.max(F.when(F.col("cand") == "A", F.col("overlap"))).alias("overlap_a"),
        F.max(F.when(F.col("cand") == "B", F.col("overlap"))).alias("overlap_b"))
    return piv.join(ovp, "id", "left").select(
        "id",
        (F.col("p_dep") == F.col("a_dep")).alias("dep_eq_a"),
        (F.col("p_dep") == F.col("b_dep")).alias("dep_eq_b"),
        (F.col("p_gdep") == F.col("a_gdep")).alias("gov_dep_eq_a"),
        (F.col("p_gdep") == F.col("b_gdep")).alias("gov_dep_eq_b"),
        (F.col("p_gupos") == F.col("a_gupos")).alias("gov_upos_eq_a"),
        (F.col("p_gupos") == F.col("b_gupos")).alias("gov_upos_eq_b"),
        F.coalesce("overlap_a", F.lit(0)).cast("long").alias("overlap_a"),
        F.coalesce("overlap_b", F.lit(0)).cast("long").alias("overlap_b"),
        F.abs(F.col("p_wi") - F.col("a_wi")).cast("int").alias("dist_a"),
        F.abs(F.col("p_wi") - F.col("b_wi")).cast("int").alias("dist_b"),
        C.is_possessive("p_xpos").cast("int").alias("possessive"))


def same_sentence(targets: DataFrame, words: DataFrame) -> DataFrame:
    """(P,A), (P,B), (A,B) in the same sentence."""
    nd = target_nodes(targets, words)
    piv = _pivot(nd.select("id", "role", "sent"), ["sent"])
    return piv.select("id", (F.col("p_sent") == F.col("a_sent")).alias("same_pa"),
                      (F.col("p_sent") == F.col("b_sent")).alias("same_pb"),
                      (F.col("a_sent") == F.col("b_sent")).alias("same_ab"))
