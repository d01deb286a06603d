"""The three workloads: localise a library of books, mine a rule table, analyse rule logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_forms, convert_primary, primary_forms
from ..operators import analysis, cache, consistency, entities, quality, repairs, rules
from ..operators.apply_rules import apply_rules, rule_hit_log, rule_hits
from ..operators.segments import extract_metadata, extract_navigation, extract_segments, fragment_for_retry, guard_entities, ordered, unmask_opaque
from ..profile import CJK, ScriptProfile
from ..storage import stored


def mine_rules(headwords: DataFrame, char_map: DataFrame, manual: DataFrame, variants: DataFrame, blocklist: DataFrame | None = None, threshold: int = 0) -> dict[str, DataFrame]:
    """rules (wrong, right, manual), excluded, bigrams and the seam report."""
    scored = rules.seam_scores(rules.generate_rules(headwords, char_map), rules.affix_frequencies(headwords))
    kept, excluded = rules.filter_rules(scored, blocklist, threshold)
    wash = {r["wrong"]: r["right"] for r in variants.collect() if len(r["wrong"]) == 1}
    return {
        "rules": rules.merge_rule_layers(kept, manual, variants, wash),
        "excluded": excluded,
        "bigrams": rules.build_bigrams(headwords),
        "seams": rules.seam_report(kept.unionByName(excluded), threshold),
    }


def localise(
    docs: DataFrame,
    char_map: DataFrame,
    headwords: DataFrame,
    rule_table: DataFrame,
    bigrams: DataFrame,
    known: DataFrame,
    engine: Callable[[Column], Column] | DataFrame | None = None,
    profile: ScriptProfile = CJK,
    repair: bool = True,
) -> dict[str, DataFrame]:
    """segments (converted), navigation, metadata, entities, cache, fallbacks, hits, consistency rules and repairs of docs
    (book_id, doc_id, doc_pos, kind, content). The engine gets what stands between the protected entities, and what it loses
    text of once more in fragments. Rules are applied to what it gives, and again to repaired text. engine: a function of a
    column or a table of translations; by default each character in its first form."""
    primary, listed = primary_forms(char_map), all_forms(char_map)
    forms = consistency.Forms(listed)
    content = docs.where("kind = 'doc'")
    found = ordered(extract_segments(content), order=("doc_id", "seg_pos"), name="pair_pos")
    names = entities.protected_entities(found.where("kind <> 'title'"), content, profile, forms.convertible, headwords)
    guarded = guard_entities(found, names)

    def convert(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """rows (text) with value, and the new entries of the cache."""
        converted, new = cache.convert_segments(cache.with_key(rows, "zh-CN", "zh-TW"), known, engine or (lambda c: convert_primary(c, primary)))
        return converted.withColumn("value", F.coalesce("value", "text")), new

    def convert_pieces(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
        """book_id, pair_pos, value: pieces (book_id, pair_pos, k, text, protected) converted, but for protected ones, and put
        together again; and the new entries of the cache."""
        done, new = convert(pieces.where("NOT protected"))
        both = done.select("book_id", "pair_pos", "k", "value").unionByName(pieces.where("protected").select("book_id", "pair_pos", "k", F.col("text").alias("value")))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: x["value"]), "")
        return both.groupBy("book_id", "pair_pos").agg(joined.alias("value")), new

    place = ["book_id", "pair_pos"]
    parts = stored(guarded.select(*place, F.posexplode("parts").alias("k", "x")).select(*place, "k", F.col("x.part").alias("text"), F.col("x.protected").alias("protected")), "parts")
    values, new = convert_pieces(parts)
    converted = stored(found.join(values, place, "left").withColumn("value", F.coalesce("value", "text")), "converted")
    # what lost text is cut at its marks and converted once more; a second failure leaves the first result
    lossy = converted.where(quality.needs_fallback(F.col("text"), F.col("value"))).select(*place, "text")
    pieces = fragment_for_retry(lossy).select(*place, F.col("frag_pos").alias("k"), F.col("fragment").alias("text"), F.lit(False).alias("protected"))
    again, more = convert_pieces(pieces)
    converted = converted.join(again.withColumnRenamed("value", "again"), place, "left")
    better = F.col("again").isNotNull() & ~quality.needs_fallback(F.col("text"), F.col("again"))
    converted = converted.withColumn("value", F.when(better, F.col("again")).otherwise(F.col("value"))).drop("again")
    new = new.unionByName(more.join(new.select("key"), "key", "left_anti"))
    rewritten = stored(apply_rules(converted.withColumn("value", unmask_opaque(F.col("value"), F.col("mask"))), rule_table, bigrams, "value"), "rewritten")
    pairs = rewritten.select("book_id", "pair_pos", F.col("text").alias("src"), F.col("applied.text").alias("tgt"))
    out = rewritten.select("book_id", "doc_id", "seg_pos", "pair_pos", "tag", "kind", F.col("applied.text").alias("text"))
    labels = {
        "navigation": extract_navigation(docs.where("kind = 'ncx'")).withColumnRenamed("title", "text"),
        "metadata": extract_metadata(docs.where("kind = 'opf'")).withColumnRenamed("value", "text"),
    }
    labels = {name: apply_rules(convert(rows)[0], rule_table, bigrams, "value").withColumn("text", F.col("applied.text")).select(rows.columns) for name, rows in labels.items()}
    lost = {}
    if repair:
        diffs = repairs.safe_repairs(repairs.diff_repairs(pairs, primary, listed, bigrams), pairs, primary)
        words = repairs.fixed_word_candidates(headwords, forms, pairs)
        contexts = repairs.fixed_word_contexts(words, pairs)
        fixes = repairs.fixed_word_repairs(repairs.fixed_word_tallies(contexts, pairs, headwords))
        out = repairs.apply_fixed_word_repairs(repairs.apply_repairs(out, diffs), fixes, contexts, headwords)
        out = stored(apply_rules(out, rule_table, bigrams).withColumn("text", F.col("applied.text")).drop("applied"), "repaired")
        lost = {"repairs": diffs, "fixed_words": fixes}
    votes = consistency.consistency_rules(pairs, forms, profile)
    failing, failures = quality.fallback_report(pairs, forms.convertible, profile)
    return {
        "segments": consistency.apply_replacements(out, votes).drop("pair_pos"),
        **labels,
        "entities": names,
        "guarded": guarded.select("book_id", "doc_id", "seg_pos", "parts"),
        "cache": cache.merge_cache(known, new),
        "fallbacks": failing,
        "fallback_counts": failures,
        "hits": rule_hit_log(rule_hits(rewritten.select("book_id", "pair_pos", "applied"))),
        "consistency": votes,
        "consistency_report": consistency.consistency_report(out.select("book_id", F.col("pair_pos").alias("seg_pos"), "text"), votes),
        **lost,
    }


def analyse_logs(snippets: DataFrame, headwords: DataFrame, profile: ScriptProfile = CJK) -> dict[str, DataFrame]:
    """metrics, neighbours, threshold and the ranking of rules over snippets (file, wrong, right, snippet)."""
    near = analysis.snippet_neighbours(snippets, profile)
    metrics = analysis.rule_metrics(near, rules.affix_frequencies(headwords))
    return {"metrics": metrics, "neighbours": analysis.top_neighbours(near), "threshold": analysis.calibrate_threshold(metrics), "ranking": analysis.rank_rules(metrics)}
