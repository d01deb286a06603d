"""The consistency pass: n-grams of source sentences aligned with their converted forms, and a majority vote on each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import is_blank, long_windows, occurrences, strip_tags, windows_between
from ..profile import ScriptProfile
from ..storage import sized, stored
from .alignment import counted_in_place
from .finder import standing
from .replace import replace_in_order, resolve_rule_conflicts


def sentences(text: Column, profile: ScriptProfile) -> Column:
    """The non-blank pieces of a text, cut after every terminator; white space after a cut is dropped."""
    cls = "[" + profile.terminators.replace("\n", "\\n") + "]"
    return F.filter(F.split(text, f"(?U)(?<={cls})\\s*"), lambda s: ~is_blank(s))


def split_sentences(df: DataFrame, profile: ScriptProfile, text: str = "text") -> DataFrame:
    """df with sent_pos and sentence, one row a sentence."""
    return df.select("*", F.posexplode(sentences(F.col(text), profile)).alias("sent_pos", "sentence"))


def sentence_pairs(pairs: DataFrame, profile: ScriptProfile) -> DataFrame:
    """book_id, pair_pos, sent_pos, src, tgt: sentence by sentence where both sides have the same number, more than one;
    else the pair as it is."""
    cut = pairs.withColumn("_s", sentences(F.col("src"), profile)).withColumn("_t", sentences(F.col("tgt"), profile))
    both = F.when((F.size("_s") == F.size("_t")) & (F.size("_s") > 1), F.arrays_zip(F.col("_s").alias("src"), F.col("_t").alias("tgt")))
    rows = cut.select("book_id", "pair_pos", F.posexplode(F.coalesce(both, F.array(F.struct("src", "tgt")))).alias("sent_pos", "x"))
    return rows.select("book_id", "pair_pos", "sent_pos", "x.src", "x.tgt")


class Forms:
    """The listed forms of convertible characters, as literals: a dictionary of a few thousand characters."""

    def __init__(self, forms: dict[str, list[str]]) -> None:
        self.forms = forms
        self.convertible = "".join(sorted(forms))
        self._legal = "|" + "|".join(sorted(f"{s}{t}" for s, ts in forms.items() for t in ts)) + "|"

    def is_convertible(self, c: Column) -> Column:
        return F.instr(F.lit(self.convertible), c) > 0 if self.forms else F.lit(False)

    def all_fixed(self, text: Column) -> Column:
        """Whether a text has no convertible character."""
        return F.translate(text, self.convertible, "") == text if self.forms else F.lit(True)

    def legal(self, s: Column, t: Column) -> Column:
        """Whether t is a listed form of s."""
        return F.instr(F.lit(self._legal), F.concat(F.lit("|"), s, t, F.lit("|"))) > 0

    def table(self, df: DataFrame) -> DataFrame:
        rows = [(s, t) for s, ts in self.forms.items() for t in ts]
        return df.sparkSession.createDataFrame(rows or [("", "")], "simp string, trad string")


def char(text: Column, i: Column) -> Column:
    return F.substring(text, i, F.lit(1))


#: No n-gram that is aligned is longer.
LONGEST = 6


def positions(n: Column) -> Column:
    return F.sequence(F.lit(1), n)


def differ(a: Column, b: Column, i: int) -> Column:
    """Whether two n-grams of one length differ in place i; beyond their end they don't."""
    return F.substring(a, i, 1) != F.substring(b, i, 1)


def hamming(a: Column, b: Column) -> Column:
    """Number of places where two n-grams of one length differ, as a plain sum that is compiled with the query."""
    total = differ(a, b, 1).cast("int")
    for i in range(2, LONGEST + 1):
        total = total + differ(a, b, i).cast("int")
    return total


def every_difference(a: Column, b: Column, test) -> Column:
    """Whether test(i) holds in every place i where a and b differ."""
    out = F.lit(True)
    for i in range(1, LONGEST + 1):
        out = out & (~differ(a, b, i) | test(i))
    return out


def script_ngrams(df: DataFrame, text: str, profile: ScriptProfile, name: str) -> DataFrame:
    """The distinct n-grams of a sentence that lie in the script: book_id, pair_pos, sent_pos, n, name."""
    runs = df.select("book_id", "pair_pos", "sent_pos", F.explode(F.regexp_extract_all(F.col(text), F.lit(profile.run_regex), F.lit(0))).alias("run"))
    grams = windows_between(F.col("run"), profile.align_min, profile.align_max)
    return runs.select("book_id", "pair_pos", "sent_pos", F.explode(grams).alias(name)).distinct().withColumn("n", F.length(name))


SENTENCE = ["book_id", "pair_pos", "sent_pos"]


def with_masks(df: DataFrame, name: str, first: int = 1) -> DataFrame:
    """df once for every place of the n-gram name from first on, with i and the n-gram without that place, m: two n-grams
    that differ in one place at most are equal in one of these."""
    rows = df.withColumn("i", F.explode(F.sequence(F.lit(first), F.length(name))))
    return rows.withColumn("m", F.concat(F.left(name, F.col("i") - 1), F.lit("\0"), F.substring(F.col(name), F.col("i") + 1, F.lit(LONGEST))))


def align_ngrams(sent_pairs: DataFrame, forms: Forms, profile: ScriptProfile) -> DataFrame:
    """book_id, pair_pos, sent_pos, s_ng, t_ng, fixed: source and target n-grams of a sentence that could be each other's
    form; each once a sentence.

    An all-fixed n-gram may differ in one place but its first, so it meets its forms by equality of what is left without a
    place. Others meet by length and first character, the source's own if it is fixed, else one of its forms; every place
    must be equal or a listed form.
    """
    source = script_ngrams(sent_pairs, "src", profile, "s_ng").withColumn("fixed", forms.all_fixed(F.col("s_ng")))
    target = script_ngrams(sent_pairs, "tgt", profile, "t_ng")
    near = with_masks(source.where("fixed"), "s_ng", 2).join(with_masks(target, "t_ng", 2), [*SENTENCE, "n", "i", "m"])
    mixed = source.where("NOT fixed").withColumn("c", char(F.col("s_ng"), F.lit(1)))
    fixed_first = mixed.where(~forms.is_convertible(F.col("c"))).withColumn("key", F.col("c"))
    other_first = mixed.where(forms.is_convertible(F.col("c"))).join(F.broadcast(forms.table(sent_pairs)), F.col("c") == F.col("simp")).drop("simp").withColumnRenamed("trad", "key")
    met = fixed_first.unionByName(other_first).join(target.withColumn("key", char(F.col("t_ng"), F.lit(1))), [*SENTENCE, "n", "key"])
    s, t = F.col("s_ng"), F.col("t_ng")
    at = lambda c, i: F.substring(c, i, 1)
    placed = every_difference(s, t, lambda i: forms.is_convertible(at(s, i)) & forms.legal(at(s, i), at(t, i)))
    columns = [*SENTENCE, "s_ng", "t_ng", "fixed"]
    return near.select(columns).unionByName(met.where(placed).select(columns)).distinct()


def competitive_abstain(aligned: DataFrame, sent_pairs: DataFrame) -> DataFrame:
    """aligned without the unequal all-fixed pairs whose target is as close to another window of the source sentence: such a
    pair differs in one place, so a rival is a window that is left equal without some place."""
    doubtful = F.col("fixed") & (F.col("s_ng") != F.col("t_ng"))
    rows = aligned.where(doubtful)
    texts = sent_pairs.join(rows.select(*SENTENCE, F.length("s_ng").alias("n")).distinct(), SENTENCE)
    windows = texts.select(*SENTENCE, F.explode(F.array_distinct(long_windows(F.col("src"), F.col("n")))).alias("w"))
    rivals = with_masks(rows, "t_ng").join(with_masks(windows, "w"), [*SENTENCE, "i", "m"]).where((F.length("w") == F.length("t_ng")) & (F.col("w") != F.col("s_ng")))
    beaten = rivals.select(*SENTENCE, "s_ng", "t_ng").distinct()
    return aligned.where(~doubtful).unionByName(rows.join(beaten, [*SENTENCE, "s_ng", "t_ng"], "left_anti").select(aligned.columns))


def alignment_counts(aligned: DataFrame) -> DataFrame:
    """book_id, s_ng, t_ng, fixed, n: the number of sentences."""
    return aligned.groupBy("book_id", "s_ng", "t_ng", "fixed").agg(F.count("*").alias("n"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """book_id, min_total, entity_total: what an n-gram needs in a book of so many pairs."""
    n = F.count("*")
    return pairs.groupBy("book_id").agg(F.greatest(F.lit(4), F.floor(n / 200)).cast("long").alias("min_total"), F.greatest(F.lit(15), F.floor(n / 50)).cast("long").alias("entity_total"))


def majority_form(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """book_id, s_ng, majority, total: an all-fixed source that is seen as itself stays itself; else the most frequent
    form, of equals the first in order; only for totals of min_total."""
    by_source = Window.partitionBy("book_id", "s_ng")
    truth = (F.col("fixed") & (F.col("s_ng") == F.col("t_ng"))).cast("int")
    rows = counts.withColumn("total", F.sum("n").over(by_source)).withColumn("_r", F.row_number().over(by_source.orderBy(truth.desc(), F.desc("n"), "t_ng")))
    rows = rows.where("_r = 1").join(limits.select("book_id", "min_total"), "book_id").where(F.col("total") >= F.col("min_total"))
    return rows.select("book_id", "s_ng", F.col("t_ng").alias("majority"), "total")


def normalization_rules(counts: DataFrame, majority: DataFrame, limits: DataFrame, forms: Forms, min_minority: int = 2, max_share: float = 0.33) -> DataFrame:
    """book_id, wrong, right, s_ng: minority forms that the majority form replaces.

    Spared are forms that are some n-gram's majority or a frequent source n-gram themselves, rare ones, and, unless an
    all-fixed source stands against them, those with a large share, those whose replacement is no legal form, and those
    that are legal forms themselves at every place.
    """
    per_source = counts.groupBy("book_id", "s_ng").agg(F.count("*").alias("n_forms"))
    rows = counts.join(majority, ["book_id", "s_ng"]).join(per_source, ["book_id", "s_ng"]).join(limits, "book_id")
    rows = rows.where((F.col("n_forms") >= 2) & (F.col("t_ng") != F.col("majority")) & (F.col("n") >= min_minority))
    truth = F.col("fixed") & (F.col("majority") == F.col("s_ng"))
    rows = rows.where(F.col("fixed") | (F.col("majority") != F.col("s_ng")))
    rows = rows.join(majority.select("book_id", F.col("majority").alias("t_ng")).distinct(), ["book_id", "t_ng"], "left_anti")
    rows = rows.join(majority.select("book_id", F.col("s_ng").alias("t_ng")), ["book_id", "t_ng"], "left_anti")
    rows = rows.where(~(truth & (F.length("s_ng") == 3) & (F.col("total") < F.col("entity_total"))))
    s, w, r = F.col("s_ng"), F.col("t_ng"), F.col("majority")
    few = hamming(w, r) <= 1
    fixed_legal = F.when((F.length("s_ng") < 4) & (w != r), (F.length("s_ng") == 3) & (F.col("total") >= F.col("entity_total")) & few).otherwise(few)
    at = lambda c, i: F.substring(c, i, 1)
    placed_legal = every_difference(w, r, lambda i: forms.legal(at(s, i), at(r, i)))
    both = every_difference(w, r, lambda i: forms.legal(at(s, i), at(w, i)) & forms.legal(at(s, i), at(r, i)))
    vote = (F.col("n") / F.col("total") < max_share) & F.when(F.col("fixed"), fixed_legal).otherwise(placed_legal) & ~both
    rows = rows.where(truth | vote)
    best = Window.partitionBy("book_id", "t_ng").orderBy(F.desc("total"), "s_ng")
    return rows.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("book_id", F.col("t_ng").alias("wrong"), F.col("majority").alias("right"), "s_ng")


def shrink_rules(rules: DataFrame, forms: Forms) -> DataFrame:
    """rules cut after their last difference; in full where the source's part is all fixed and shorter than 4; a cut form
    with two outcomes is dropped. One row a form, of several sources the first in order."""
    last = F.array_max(F.filter(positions(F.length("wrong")), lambda i: char(F.col("wrong"), i) != char(F.col("right"), i)))
    rows = rules.withColumn("_k", last).where(F.col("_k").isNotNull())
    full = forms.all_fixed(F.left(F.col("s_ng"), F.col("_k"))) & (F.col("_k") < 4)
    rows = rows.withColumn("_k", F.when(full, F.length("wrong")).otherwise(F.col("_k")))
    cut = rows.select("book_id", F.left("wrong", F.col("_k")).alias("wrong"), F.left("right", F.col("_k")).alias("right"), "s_ng")
    return cut.groupBy("book_id", "wrong").agg(F.min("right").alias("right"), F.max("right").alias("_m"), F.min("s_ng").alias("s_ng")).where(F.col("right") == F.col("_m")).drop("_m")


def apply_replacements(segments: DataFrame, rules: DataFrame, order: tuple[str, ...] | None = None, text: str = "text") -> DataFrame:
    """segments with the book's rules applied one after the other to the whole text, longest wrong form first, or by the
    given columns."""
    return replace_in_order(segments, rules, [F.col(c) for c in order] if order else [-F.length("wrong"), F.col("wrong")], text)


def consistency_report(segments: DataFrame, rules: DataFrame, keep: int = 5, around: int = 35) -> DataFrame:
    """book_id, wrong, right, s_ng, k, before, after: the first keep places of every rule with their surroundings, markup
    left out. segments: book_id, seg_pos (one row each), text; rules: wrong forms of up to LONGEST characters."""
    rules, small = sized(stored(rules, "rules"))
    plain = segments.select("book_id", "seg_pos", strip_tags(F.col("text"), empty_too=False).alias("t"))
    if small:  # most texts have none
        held = plain.select("*", F.explode(standing(F.col("t"), rules.select("wrong"))).alias("wrong")).join(rules, ["book_id", "wrong"])
    else:  # every text's windows are looked up among the book's wrong forms, all of which are short
        windows = F.array_distinct(F.flatten(F.array(*[long_windows(F.col("t"), n) for n in range(1, LONGEST + 1)])))
        found = plain.select("book_id", "seg_pos", F.explode(windows).alias("wrong")).join(rules, ["book_id", "wrong"])
        held = plain.join(found, ["book_id", "seg_pos"])
    places = held.select("*", F.explode(occurrences(F.col("t"), F.col("wrong"))).alias("p"))
    first = Window.partitionBy("book_id", "wrong").orderBy("seg_pos", "p")
    rows = places.withColumn("k", F.row_number().over(first)).where(F.col("k") <= keep)
    left = F.greatest(F.col("p") - around, F.lit(1))
    before = F.substring(F.col("t"), left, F.col("p") - left + F.length("wrong") + around)
    after = F.concat(F.substring(F.col("t"), left, F.col("p") - left), F.col("right"), F.substring(F.col("t"), F.col("p") + F.length("wrong"), F.lit(around)))
    return rows.select("book_id", "wrong", "right", "s_ng", "k", before.alias("before"), after.alias("after"))


def consistency_rules(pairs: DataFrame, forms: Forms, profile: ScriptProfile) -> DataFrame:
    """The whole pass over pairs (book_id, pair_pos, src, tgt): book_id, wrong, right, s_ng."""
    counts = aligned_counts(pairs, forms, profile)
    limits = pair_counts(pairs)
    majority = majority_form(counts, limits)
    return resolve_rule_conflicts(shrink_rules(normalization_rules(counts, majority, limits, forms), forms))


def aligned_counts(pairs: DataFrame, forms: Forms, profile: ScriptProfile) -> DataFrame:
    """alignment_counts of pairs, worked out once and stored. A sentence is aligned in its row, so that no n-gram is shuffled
    but in counts; only pairs of which several share a key meet in joins, as one."""
    pairs = pairs.where("book_id IS NOT NULL AND pair_pos IS NOT NULL")
    again = stored(pairs.groupBy("book_id", "pair_pos").count().where("count > 1").select("book_id", "pair_pos"), "again")
    sent = sentence_pairs(pairs, profile)
    local = lambda df: counted_in_place(df, forms.forms, profile.run_regex, profile.align_min, profile.align_max)
    if again.limit(1).count():
        own = sentence_pairs(pairs.join(again, ["book_id", "pair_pos"], "left_semi"), profile)
        aligned = stored(align_ngrams(own, forms, profile), "aligned")
        rows = local(sent.join(again, ["book_id", "pair_pos"], "left_anti")).unionByName(alignment_counts(competitive_abstain(aligned, own)))
    else:
        rows = local(sent)
    return stored(rows.groupBy("book_id", "s_ng", "t_ng", "fixed").agg(F.sum("n").alias("n")), "counts")
