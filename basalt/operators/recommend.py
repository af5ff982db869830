"""Recommendations for all users at once: pathways, neighbours, hybrid scores, rules and guardrails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import work_folder

#: Rows with a token that may be broadcast, and the bytes that each one's token may have: some 20 MB as a hash table, whatever the input.
MOST_BROADCAST, LONGEST_BROADCAST = 100_000, 64


def _place(by: list[str], *order) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))


def _small(df: DataFrame):
    """``broadcast`` for what has no more rows and bytes of tokens than ``df``, if these are few enough."""
    n = df.select(F.octet_length("token").alias("bytes")).limit(MOST_BROADCAST + 1).agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).first()
    return F.broadcast if n.rows <= MOST_BROADCAST and (n.bytes or 0) <= MOST_BROADCAST * LONGEST_BROADCAST else lambda x: x


def _written(df: DataFrame, name: str) -> DataFrame:
    """A table that is small, or a row for each id, written and read back.

    The driver holds the text of each plan, and in it a table that is kept in memory
    stands with the plans of all that it was made of, once for every use.
    """
    df.write.parquet(path := work_folder(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


# -- pathways ---------------------------------------------------------------------------


def pathway_profile(items: DataFrame) -> DataFrame:
    """(target, entity, item) rows -> for each target and item its entities and their share of the target's."""
    size = items.groupBy("target").agg(F.countDistinct("entity").alias("size"))
    held = items.groupBy("target", "item").agg(F.countDistinct("entity").alias("n"))
    return held.join(size, "target").select("target", "item", "n", "size", (F.col("n") / F.col("size")).alias("coverage"))


def top_nodes(profile: DataFrame, k: int) -> DataFrame:
    return profile.withColumn("place", _place(["target"], F.desc("n"), "item")).where(F.col("place") <= k)


def cold_start(history: DataFrame, threshold: int = 3) -> DataFrame:
    """(user, item) -> users with their history size, and the shortfall of those below the threshold."""
    return history.groupBy("user").agg(F.countDistinct("item").alias("n_items")).select("user", "n_items", (F.col("n_items") < threshold).alias("is_cold"), F.greatest(F.lit(threshold) - F.col("n_items"), F.lit(0)).alias("shortfall"))


def guidance_items(users: DataFrame, history: DataFrame, profile: DataFrame, outcomes: int = 3, k: int = 2) -> DataFrame:
    """For cold users: the top items of the first outcomes that they do not hold."""
    first = profile.select("target").distinct().orderBy("target").limit(outcomes)
    offers = top_nodes(profile, k).join(first, "target").select("target", "item")
    return users.select("user").join(offers, how="cross").join(history.select("user", "item").distinct(), ["user", "item"], "left_anti")  # at most outcomes * k offers


def pathway_match(history: DataFrame, secondary: DataFrame, groups: DataFrame, primary_profile: DataFrame, secondary_profile: DataFrame, top_primary: int = 5, top_secondary: int = 3) -> DataFrame:
    """Alignment of every user with every target.

    0.60 coverage-weighted overlap with the target's top items + 0.25 overlap with
    its top secondary items (0.5 without any) + 0.15 for a group that the target
    has (0.5 else).  ``groups``: (user, group) and the targets' groups in (target, group).
    """
    tops = top_nodes(primary_profile, top_primary)
    weight = tops.groupBy("target").agg(F.sum("coverage").alias("w"))
    targets = weight.join(top_nodes(secondary_profile, top_secondary).groupBy("target").agg(F.count("*").alias("k")), "target", "left")
    base = groups.select("user", "group").join(targets, how="cross")  # targets are few
    hit = history.select("user", "item").distinct().join(tops, "item").groupBy("user", "target").agg(F.sum("coverage").alias("hit"))
    second = secondary.select("user", "item").distinct().join(top_nodes(secondary_profile, top_secondary), "item").groupBy("user", "target").agg(F.count("*").alias("second"))
    joined = base.join(hit, ["user", "target"], "left").join(second, ["user", "target"], "left")
    p = F.coalesce(F.col("hit"), F.lit(0.0)) / F.col("w")
    s = F.when(F.col("k").isNull(), 0.5).otherwise(F.coalesce(F.col("second"), F.lit(0)) / F.col("k"))
    return joined.select("user", "target", (0.6 * p + 0.25 * s + 0.15 * F.when(F.col("group"), 1.0).otherwise(0.5)).alias("score"))


def next_nodes(history: DataFrame, goals: DataFrame, profile: DataFrame, top: int = 5, k: int = 2) -> DataFrame:
    """(user, target) goals -> the first k of the target's top items that the user lacks."""
    missing = goals.join(top_nodes(profile, top).select("target", "item", "place"), "target").join(history.select("user", "item").distinct(), ["user", "item"], "left_anti")
    return missing.withColumn("step", _place(["user", "target"], "place")).where(F.col("step") <= k).drop("place")


def recency_filter(df: DataFrame, year: str, reference: int, years: int) -> DataFrame:
    """Rows of the last years; all rows where that would leave none."""
    kept = df.agg(F.count_if(F.col(year) >= reference - years).alias("__n"))
    return df.join(kept, how="cross").where((F.col(year) >= reference - years) | (F.col("__n") == 0)).drop("__n")


def recency_report(df: DataFrame, year: str, reference: int, years: int) -> DataFrame:
    """Rows that the recency filter removes, and their share."""
    old = F.count_if(~F.coalesce(F.col(year) >= reference - years, F.lit(False)))
    row = df.agg(F.count("*").alias("n_rows"), old.alias("old"))
    removed = F.when(F.col("old") < F.col("n_rows"), F.col("old")).otherwise(0)  # all rows stay where none is recent
    return row.select("n_rows", removed.alias("removed"), F.round(100 * removed / F.greatest("n_rows", F.lit(1)), 2).alias("removed_pct"))


# -- neighbours -------------------------------------------------------------------------


def profile_document(df: DataFrame, major: str, items: str) -> Column:
    """A profile as text: the major and its items, spaces in names as underscores."""
    clean = lambda c: F.regexp_replace(c, r"\s+", "_")
    return F.array_join(F.concat(F.array(F.concat(F.lit("major_"), clean(F.col(major)))), F.transform(F.col(items), clean)), " ")


def token_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(id, token, tf); texts are shuffled by id, and nothing by token: all that follows by id needs no other shuffle."""
    own = df.select(F.col(key).alias("id"), F.col(text).alias("text")).repartition("id")
    return own.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\w-]+"), F.lit(0))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, n_docs: DataFrame) -> DataFrame:
    """Smooth inverse document frequencies; ``n_docs`` is a one-row table with the number of documents in ``docs``."""
    held = counts.groupBy("token").agg(F.count("*").alias("n")).join(n_docs, how="cross")  # one row
    return held.select("token", (F.log((1 + F.col("docs")) / (1 + F.col("n"))) + 1).alias("idf"))


def weights_of(weights: DataFrame, counts: DataFrame) -> DataFrame:
    """The (token, idf) that ``counts`` have a use for."""
    tokens = counts.select("token").distinct()
    return weights.join(_small(tokens)(tokens), "token", "left_semi")


def tfidf(counts: DataFrame, weights: DataFrame, most: int = MOST_BROADCAST, tokens: DataFrame | None = None) -> DataFrame:
    """L2-normalised smooth tf-idf in long form; the norm is an aggregate joined back, not a window.

    The ``most`` most common tokens' weights are broadcast, so almost all postings stay
    where ``token_counts`` left them, by id; only those of rarer tokens, which have few
    each, and of tokens beyond ``LONGEST_BROADCAST`` bytes are shuffled by token.  Norms
    are a row for each id and the side of a hash join that is built.

    With ``tokens`` only their postings come out (norms are of all).  ``counts`` are
    read several times and are best kept.
    """
    weights = weights.persist()
    short = F.octet_length("token") <= LONGEST_BROADCAST
    cut, room, left = None, most, False
    for r in weights.groupBy("idf").agg(F.count_if(short).alias("n"), F.count_if(~short).alias("long")).orderBy("idf").toLocalIterator():  # a row for each number of documents that a token is in
        left = left or r.long > 0
        if r.n > room:
            left = True
            break
        cut, room = r.idf, room - r.n
    worth = lambda df: df.select("id", "token", (F.col("tf") * F.col("idf")).alias("w"))
    parts, rest = [], counts
    if cut is not None or not left:
        is_common = short & (F.col("idf") <= F.lit(cut)) if left else F.lit(True)
        common = F.broadcast(weights.where(is_common))
        parts.append(worth(counts.join(common, "token")))
        rest = counts.join(common, "token", "left_anti")
    if left:
        parts.append(worth(rest.join(weights if cut is None else weights.where(~is_common), "token")))
    squares = [p.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("s")) for p in parts]
    every = squares[0] if len(squares) == 1 else squares[0].unionByName(squares[1]).groupBy("id").agg(F.sum("s").alias("s"))
    norm = every.select("id", F.sqrt("s").alias("norm"))
    if tokens is not None:
        norm, weights = _written(norm, "norms"), _written(weights_of(weights, tokens), "weights")
        parts = [worth(counts.join(_small(weights)(weights), "token"))]
    made = [p.join(norm.hint("shuffle_hash"), "id").select("id", "token", (F.col("w") / F.col("norm")).alias("weight")) for p in parts]
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


#: Postings that a query's rarest tokens may have for a first guess of its k-th similarity.
FIRST_POSTINGS = 1000
#: Similarities that are this close count as equal when documents are ruled out.
SLACK = 1e-9


def pruned_postings(queries: DataFrame, corpus: DataFrame, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """What ``cosine_topk`` needs of the inverted index: (query, token, a, is_essential, rest, least), and the corpus' postings of the queries' tokens in (id, token, b).

    No token adds more to a similarity than its weight in the query times its
    largest weight in the corpus.  The similarities over a query's rarest tokens give
    ``least``, which k documents reach for certain.  Then the most common tokens are
    set aside as long as their bounds together (``rest``) stay below it: a document
    that has nothing but these can't be among the first k.
    """
    asked = _written(queries.select(F.col("id").alias("query"), "token", F.col("weight").alias("a")), "asked")
    small = _small(asked)
    held = corpus.select("id", "token", F.col("weight").alias("b")).join(small(asked.select("token").distinct()), "token", "left_semi").persist()  # no other token is ever met
    wanted = held.groupBy("token").agg(F.count("*").alias("df"), F.max("b").alias("top"))
    bounds = _written(asked.join(wanted, "token").select("query", "token", "a", "df", (F.col("a") * F.col("top")).alias("bound")), "bounds")
    rare = Window.partitionBy("query").orderBy("df", "token")
    first = bounds.withColumn("sum", F.sum("df").over(rare)).where((F.col("sum") <= FIRST_POSTINGS) | (F.col("sum") == F.col("df"))).select("query", "token", "a")
    some = small(first).join(held, "token").groupBy("query", "id").agg(F.sum(F.col("a") * F.col("b")).alias("sim"))
    least = some.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim")))).where(F.col("place") == k).select("query", F.col("sim").alias("least"))
    common = Window.partitionBy("query").orderBy(F.desc("df"), F.desc("token"))
    aside = bounds.join(least, "query", "left").withColumn("sum", F.sum("bound").over(common))
    aside = aside.withColumn("is_essential", F.col("least").isNull() | (F.col("sum") >= F.col("least") - SLACK))
    rest = F.coalesce(F.max(F.when(~F.col("is_essential"), F.col("sum"))).over(Window.partitionBy("query")), F.lit(0.0))
    return _written(aside.select("query", "token", "a", "df", "is_essential", rest.alias("rest"), F.coalesce("least", F.lit(0.0)).alias("least")), "postings"), held


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int = 5, digits: int = 9) -> DataFrame:
    """The k most similar corpus documents of every query (ties by id), by an inverted index without the postings that can't matter.

    Documents that share an essential token (see ``pruned_postings``) get their
    similarity over these; those that can't reach the k-th any more go, and only the
    others meet the query's common tokens, as one row for each document.  Weights must
    not be negative.

    Query tokens are broadcast if there are at most ``MOST_BROADCAST``, so that no
    token needs a task of its own and postings that lie by id (as those of ``tfidf``
    do) stay where they are; more are joined by token.  The corpus is kept for the
    passes over it, the queries' own tables are written (see ``_written``).
    """
    asked, held = pruned_postings(queries, corpus, k)
    small = _small(asked)
    others = asked.where("not is_essential")
    rule = asked.groupBy("query").agg(F.max("rest").alias("rest"), F.max("least").alias("least"), F.collect_list(F.when(~F.col("is_essential"), F.struct("token", "a"))).alias("others"))
    near = small(asked.where("is_essential").select("query", "token", "a")).join(held, "token").groupBy("query", "id").agg(F.sum(F.col("a") * F.col("b")).alias("part"))
    near = near.join(small(rule), "query").where(F.col("part") + F.col("rest") >= F.col("least") - SLACK).select("query", "id", "part", "others")
    own = held.join(small(others.select("token").distinct()), "token", "left_semi").groupBy("id", "token").agg(F.sum("b").alias("b"))
    own = own.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("token", "b"))).alias("own"))
    more = F.aggregate("others", F.lit(0.0), lambda s, t: s + t["a"] * F.coalesce(F.col("own")[t["token"]], F.lit(0.0)))
    sims = near.join(own.hint("shuffle_hash"), "id", "left").select("query", "id", F.round(F.col("part") + more, digits).alias("sim"))
    return sims.withColumn("place", _place(["query"], F.desc("sim"), "id")).where(F.col("place") <= k)


def weighted_vote(neighbours: DataFrame) -> DataFrame:
    """(user, outcome, sim) -> score of each outcome: 0.4 of its share of similarity + 0.6 of its mean, at most 1."""
    known = neighbours.where("outcome is not null and outcome <> 'UNKNOWN'").groupBy("user", "outcome").agg(F.sum("sim").alias("total"), F.count("*").alias("n"), F.avg("sim").alias("mean"))
    every = F.greatest(F.sum("total").over(Window.partitionBy("user")), F.lit(1.0))
    return known.withColumn("score", F.least(0.4 * F.col("total") / every + 0.6 * F.col("mean"), F.lit(1.0)))


def neighbour_items(neighbours: DataFrame, items: DataFrame, history: DataFrame, k: int = 2) -> DataFrame:
    """(user, id) neighbours and (id, item) -> the k items most of them hold and the user does not."""
    counted = neighbours.join(items.distinct(), "id").groupBy("user", "item").agg(F.count("*").alias("holders"))
    fresh = counted.join(history.select("user", "item").distinct(), ["user", "item"], "left_anti")
    return fresh.withColumn("place", _place(["user"], F.desc("holders"), "item")).where(F.col("place") <= k)


def shared_items(neighbours: DataFrame, items: DataFrame, history: DataFrame) -> DataFrame:
    """(user, id, shared): the items that a user and each of its neighbours both hold."""
    own = history.select("user", "item").distinct()
    both = neighbours.select("user", "id").distinct().join(items.select("id", "item").distinct(), "id").join(own, ["user", "item"])
    return both.groupBy("user", "id").agg(F.sort_array(F.collect_set("item")).alias("shared"))


def shared_key_items(asking: DataFrame, holding: DataFrame, items: DataFrame, history: DataFrame, k: int = 2) -> DataFrame:
    """(user, key), (id, key) and (id, item) -> the k items that most others who share a key with a user hold and the user does not.

    Users and holders meet by their sets of keys, never in pairs: holders of an
    item are counted by key set, and counts are added up over the key sets that
    overlap a user's.  A user is no neighbour of its own; as only items that it
    does not hold count, it never adds to them.
    """
    of = lambda df, name, own: df.groupBy(name).agg(F.sort_array(F.collect_set("key")).alias(own))
    users, holders = of(asking, "user", "mine"), of(holding, "id", "theirs")
    counted = holders.join(items.distinct(), "id").groupBy("theirs", "item").agg(F.count("*").alias("n"))
    each = lambda df, c: df.select(c).distinct().withColumn("key", F.explode(c))
    meet = each(users, "mine").join(each(holders, "theirs"), "key").select("mine", "theirs").distinct()
    offers = meet.join(counted, "theirs").groupBy("mine", "item").agg(F.sum("n").alias("holders"))
    fresh = users.join(offers, "mine").select("user", "item", "holders").join(history.select("user", "item").distinct(), ["user", "item"], "left_anti")
    return fresh.withColumn("place", _place(["user"], F.desc("holders"), "item")).where(F.col("place") <= k)


def popular_items(df: DataFrame, group: str, item: str, k: int = 3) -> DataFrame:
    counted = df.groupBy(F.col(group).alias("group"), F.col(item).alias("item")).agg(F.count("*").alias("n"))
    return counted.withColumn("place", _place(["group"], F.desc("n"), "item")).where(F.col("place") <= k)


# -- hybrid -----------------------------------------------------------------------------

WEIGHTS = {"ml": 0.35, "tree": 0.30, "persona": 0.20, "popularity": 0.15}


def hybrid_score(signals: dict[str, DataFrame], weights: dict[str, float] = WEIGHTS, k: int = 5) -> DataFrame:
    """(user, item, value) of each signal -> weighted score, shares of the signals, and rank.

    A missing signal counts 0, a missing popularity 0.5.
    """
    out = None
    for name, df in signals.items():
        one = df.select("user", "item", F.col("value").alias(name))
        out = one if out is None else out.join(one, ["user", "item"], "full")
    total = sum(weights[n] for n in signals)
    out = out.fillna({n: 0.5 if n == "popularity" else 0.0 for n in signals})
    parts = {n: F.col(n) * (weights[n] / total) for n in signals}
    score = sum(parts.values(), F.lit(0.0))
    out = out.withColumn("score", score).withColumns({f"{n}_pct": F.when(F.col("score") > 0, 100 * p / F.col("score")).otherwise(100.0 / len(signals)) for n, p in parts.items()})
    return out.withColumn("rank", _place(["user"], F.desc(F.round("score", 9)), "item")).where(F.col("rank") <= k)


# -- rules ------------------------------------------------------------------------------


def prereq_check(candidates: DataFrame, prerequisites: DataFrame, completed: DataFrame) -> DataFrame:
    """(user, item) candidates -> whether all prerequisites (item, needs) are completed, and which are missing."""
    needs = candidates.join(prerequisites, "item")
    lacking = needs.join(completed.select("user", F.col("item").alias("needs")).distinct(), ["user", "needs"], "left_anti").groupBy("user", "item").agg(F.sort_array(F.collect_set("needs")).alias("missing"))
    out = candidates.join(lacking, ["user", "item"], "left")
    return out.select("user", "item", F.col("missing").isNull().alias("eligible"), F.coalesce(F.array_join("missing", ","), F.lit("")).alias("missing"))


def mandatory_first(ready: DataFrame, most_mandatory: int = 2, most: int = 5) -> DataFrame:
    """(user, item, is_mandatory, rank) -> at most two mandatory items, then electives, at most five."""
    own = ready.groupBy("user", "item").agg(F.max("is_mandatory").alias("is_mandatory"), F.min("rank").alias("rank"))
    within = own.withColumn("w", _place(["user", "is_mandatory"], "rank", "item")).where(~F.col("is_mandatory") | (F.col("w") <= most_mandatory))
    return within.withColumn("place", _place(["user"], F.desc("is_mandatory"), "rank", "item")).where(F.col("place") <= most).select("user", "item", "is_mandatory", "place")


def credit_simulation(taken: DataFrame, planned: DataFrame, types: DataFrame, required: DataFrame) -> DataFrame:
    """Completed, planned and projected credits by type against what is required (type, needed)."""
    every = taken.select("user", "item", F.lit(1).alias("done")).unionByName(planned.select("user", "item", F.lit(0).alias("done"))).join(types, "item")
    got = every.groupBy("user", "type").agg(F.sum(F.when(F.col("done") == 1, F.col("credits")).otherwise(0)).alias("completed"), F.sum(F.when(F.col("done") == 0, F.col("credits")).otherwise(0)).alias("planned"))
    projected = F.col("completed") + F.col("planned")
    return got.join(required, "type").select("user", "type", "completed", "planned", projected.alias("projected"), F.round(F.least(F.lit(100.0), 100 * projected / F.col("needed")), 2).alias("pct"), (projected >= F.col("needed")).alias("is_safe"))


def remaining_mandatory(taken: DataFrame, planned: DataFrame, mandatory: DataFrame) -> DataFrame:
    """(user, item) of the mandatory items that a user has neither taken nor planned; of mandatory items there may be ``MOST_BROADCAST``."""
    users = taken.select("user").unionByName(planned.select("user")).distinct()
    held = taken.select("user", "item").unionByName(planned.select("user", "item"))
    items = mandatory.select("item").distinct()
    if items.limit(MOST_BROADCAST + 1).count() > MOST_BROADCAST:
        raise ValueError(f"more than {MOST_BROADCAST} mandatory items for each user")
    held = held.join(F.broadcast(items), "item", "left_semi").select("user", "item").distinct()  # once each, and nothing else, is joined and sorted
    return users.join(F.broadcast(items), how="cross").join(held, ["user", "item"], "left_anti")  # every user needs every such item


def guardrails(df: DataFrame, domain: str) -> DataFrame:
    """``allowed`` and ``reason`` (the first rule that is broken) of candidate rows.

    university: enrolled_credits, credits, credit_cap, has_prerequisite;
    ecommerce: stock_count, discount_rate; fintech: dsr_ratio, credit_score.
    """
    rules = {
        "university": [(F.col("enrolled_credits") + F.col("credits") > F.col("credit_cap"), "credit cap"), (~F.col("has_prerequisite"), "prerequisite")],
        "ecommerce": [(F.col("stock_count") < 5, "stock"), (F.col("discount_rate") > 0.30, "discount")],
        "fintech": [(F.col("dsr_ratio") > 0.40, "debt ratio"), (F.col("credit_score") < 600, "credit score")],
    }[domain]
    reason = F.lit("ok")
    for broken, name in reversed(rules):
        reason = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(reason)
    return df.withColumn("reason", reason).withColumn("allowed", F.col("reason") == "ok")


def tier(risk: Column, high: float, middle: float, names: tuple[str, str, str]) -> Column:
    return F.when(risk >= high, names[0]).when(risk >= middle, names[1]).otherwise(names[2])


def prescription_tier(df: DataFrame, risk: str, actions: DataFrame) -> DataFrame:
    """Tier by 0.70 and 0.40, joined with the recipe's action table (tier, action)."""
    return df.withColumn("tier", tier(F.col(risk), 0.70, 0.40, ("HIGH", "MEDIUM", "LOW"))).join(actions, "tier", "left")


def care_prescription(df: DataFrame, risk: str, factors: str) -> DataFrame:
    """Care level by 0.65 and 0.25 with the leading factor."""
    level = tier(F.col(risk), 0.65, 0.25, ("URGENT", "CARE", "STABLE"))
    return df.withColumn("care", level).withColumn("primary_factor", F.coalesce(F.get(F.col(factors), F.lit(0)), F.lit("none")))


# -- rule parsing -----------------------------------------------------------------------

# Header names of curriculum tables, in the order in which they are looked for.
ALIASES = {
    "course": ("과목명", "교과목명", "교과목", "과목", "교과목_명", "과목_명", "course_name", "course", "subject", "target_course", "course_title"),
    "prerequisites": ("선수과목", "선수과목명", "선수교과목", "선수과목들", "선수과목(콤마구분)", "선수_과목", "선수_교과목", "선수이수과목", "prerequisite", "prerequisites", "prereq", "prereqs", "prerequisite_courses"),
    "type": ("이수구분", "구분", "과목구분", "이수체계", "교과구분", "이수_구분", "course_type", "type", "classification", "category"),
    "credits": ("학점", "이수학점", "학점수", "단위수", "credit", "credits", "point"),
}
# Course types and their short forms.
TYPES = {"전공필수": "전필", "전필": "전필", "전공선택": "전선", "전선": "전선", "전공기초": "전기", "전공심화": "전심", "교양필수": "교필", "교필": "교필", "교양선택": "교선", "교선": "교선", "일반선택": "일선", "일선": "일선"}
#: More header names and English course types, which the library adds.
MORE_ALIASES = {"credits": ("units",), "prerequisites": ("requires",), "course": ("name",)}
ENGLISH_TYPES = {"mandatory": ("mandatory", "required", "core"), "elective": ("elective", "optional")}
#: A course's name in a sentence.
NAME = "[가-힣A-Za-z0-9_]+"
# How sentences state prerequisites and course types.
NEEDS_LIST = rf"({NAME})\s*(?:의|은|는)?\s*선수\s*(?:과목|교과목)?\s*(?:은|는|:)\s*([가-힣A-Za-z0-9_,\s]+)"
NEEDS_ONE = rf"({NAME})\s*(?:과목|교과목)?\s*(?:을|를|은|는)?\s*(?:수강하려면|이수하려면|들으려면|수강하기\s*위해|이수하기\s*위해|듣기\s*위해)[^.\n]*?({NAME})\s*(?:과목|교과목)?\s*(?:을|를)?\s*(?:선수|필수|먼저|선이수)\s*(?:이수|수강|들어야)"
TYPE_LIST = r"(전공필수|전필|전공선택|전선|교양필수|교필)\s*(?:과목|교과목)?\s*(?:은|는|:)\s*([가-힣A-Za-z0-9_,\s]+)"
# The credits that a line or a table row asks for, and their names in results.
#: The unit after a number may be left out, so lines without it count too.
CREDITS = {"total": ("총학점", r"(?:총\s*(?:이수)?학점|졸업학점|전체학점)\s*[:=\s]*(\d+)"), "mandatory": ("전필", r"(?:전공필수|전필)\s*[:=\s]*(\d+)"), "elective": ("전선", r"(?:전공선택|전선)\s*[:=\s]*(\d+)"), "general": ("교양", r"(?:교양|교양학점)\s*[:=\s]*(\d+)")}
#: Words that are no course.
FILLERS = ("반드시", "과목", "교과목", "필수", "선수")
NO_NEEDS = ("nan", "none", "-", "없음", "")


def normal_type(c: Column) -> Column:
    """The short form of a course type; English types as mandatory or elective; others as they are."""
    own = F.trim(c)
    out = own
    for name, words in ENGLISH_TYPES.items():
        out = F.when(F.lower(own).rlike("|".join(words)), name).otherwise(out)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), own), out)


def clean_course(token: Column) -> Column:
    """A course's name without the word for course, a particle, or the word for must."""
    # The three endings and beginnings that go, which the result depends on.
    t = F.trim(F.regexp_replace(F.trim(token), "(?:과목|교과목)$", ""))
    t = F.trim(F.regexp_replace(t, "(?:을|를|은|는|이|가|의)$", ""))
    return F.trim(F.regexp_replace(t, r"^(?:반드시|필수|선수)\s*", ""))


def curriculum_rules(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(course, type, credits) and (item, needs) from a curriculum table, Korean or English, of any header spelling."""
    named = {role: next((c for a in (*names, *MORE_ALIASES.get(role, ())) for c in df.columns if a in c.strip().lower()), None) for role, names in ALIASES.items()}
    text = lambda role: F.col(f"`{named[role]}`").cast("string") if named[role] else F.lit(None).cast("string")
    credits = F.trim(F.regexp_replace(text("credits"), "학점|credits?|units?", "")).try_cast("double").cast("int")
    rows = df.select(F.trim(text("course")).alias("course"), normal_type(text("type")).alias("type"), credits.alias("credits"), F.trim(text("prerequisites")).alias("p")).where("lower(course) not in ('', 'nan', 'none')")
    given = rows.where(~F.lower("p").isin(*NO_NEEDS))
    needs = given.select(F.col("course").alias("item"), F.explode(F.transform(F.split("p", r"[,;/+\n\r]+"), lambda x: F.trim(x))).alias("needs")).where("needs <> ''").distinct()
    return rows.drop("p"), needs


def text_rules(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rules in the lines of a corpus of documents, Korean or English: (key, line_no, kind, subject, value).

    Of the patterns for prerequisites and types the first that a line has counts;
    a line without one may state several credit requirements.
    """
    lines = docs.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "raw"))
    lines = lines.select(key, "line_no", F.regexp_replace(F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")), r"^[-*•\d.]+\s*", "").alias("line")).where("line <> ''")
    rule = lambda kind, subject, value: F.struct(F.lit(kind).alias("kind"), subject.alias("subject"), value.alias("value"))
    part = lambda pattern, i: F.regexp_extract("line", pattern, i)
    names = lambda pattern: F.transform(F.split(F.trim(part(pattern, 2)), r"[,/및\s]+"), clean_course)
    real = lambda x: (x != "") & ~x.isin(*FILLERS)
    none = F.array().cast("array<struct<kind:string,subject:string,value:string>>")

    owner = clean_course(part(NEEDS_LIST, 1))
    listed = F.when(owner != "", F.transform(F.filter(names(NEEDS_LIST), real), lambda x: rule("prerequisite", owner, x))).otherwise(none)
    wants, needed = clean_course(part(NEEDS_ONE, 1)), clean_course(part(NEEDS_ONE, 2))
    single = F.when((wants != "") & real(needed), F.array(rule("prerequisite", wants, needed))).otherwise(none)
    typed = F.transform(F.filter(names(TYPE_LIST), lambda x: (F.length(x) >= 2) & ~x.rlike(r"^\d+$")), lambda x: rule("type", x, normal_type(part(TYPE_LIST, 1))))
    credits = F.filter(F.array(*[F.when(F.col("line").rlike(p), rule("credits", F.lit(name), part(p, 1))) for name, p in CREDITS.values()]), lambda x: x.isNotNull())
    out = credits
    english = [
        ("prerequisite", r"(?i)^\s*(.+?)\s+requires\s+(.+?)\s*\.?\s*$"),
        ("prerequisite", r"(?i)^\s*prerequisites? (?:for|of)\s+(.+?)\s*:\s*(.+?)\s*\.?\s*$"),
        ("type", r"(?i)^\s*(.+?)\s+is\s+(?:an?\s+)?(mandatory|required|core|elective|optional)\b.*$"),
        ("credits", r"(?i)^.*?\b(total|mandatory|elective)\s+credits?\D*(\d+).*$"),
    ]
    for kind, p in reversed(english):
        out = F.when(F.col("line").rlike(p), F.array(rule(kind, part(p, 1), part(p, 2)))).otherwise(out)
    for pattern, found in ((TYPE_LIST, typed), (NEEDS_ONE, single), (NEEDS_LIST, listed)):
        out = F.when(F.col("line").rlike(pattern), found).otherwise(out)
    return lines.select(key, "line_no", F.explode(out).alias("r")).select(key, "line_no", "r.*")


def requirement_cells(docs: DataFrame, key: str, cells: list[str], order: str | None = None) -> DataFrame:
    """Credit requirements found anywhere in a row's cells, Korean or English; of several of a key the last counts (by ``order`` and line)."""
    line = F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in cells])
    number = lambda name, p: F.coalesce(F.nullif(F.regexp_extract("line", p, 1), F.lit("")), F.regexp_extract("line", rf"(?i){name}\D*(\d+)", 1)).try_cast("int")
    # How cells name these two credits.
    patterns = {name: p for name, (_, p) in CREDITS.items()} | {"total": r"(?:총학점|졸업학점|총이수학점|전체학점)\s*[:=\s]*(\d+)", "semester": r"학기당\s*[:=\s]*(\d+)"}
    rows = docs.select(F.col(key), (F.col(order) if order else F.lit(0)).alias("row_no"), F.posexplode(F.split(line, "\n")).alias("line_no", "line"))
    found = rows.select(key, "row_no", "line_no", *[number(n, p).alias(n) for n, p in patterns.items()])
    return found.groupBy(key).agg(*[F.max_by(n, F.when(F.col(n).isNotNull(), F.struct("row_no", "line_no"))).alias(n) for n in patterns])


def json_rules(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, item, needs) from JSON documents of item -> list or delimited string."""
    from ..functions.expressions import split_items

    entries = docs.select(F.col(key), F.explode(F.from_json(column, "map<string,string>")).alias("item", "v"))
    parts = F.when(F.trim("v").startswith("["), F.from_json("v", "array<string>")).otherwise(split_items(F.col("v")))
    return entries.select(key, "item", F.explode(parts).alias("needs"))


def rule_override(defaults: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    return defaults.join(overrides.select(*keys).distinct(), keys, "left_anti").unionByName(overrides)


def label_vs_prediction(labels: DataFrame, predictions: DataFrame, key: str, label: str, predicted: str) -> DataFrame:
    return labels.join(predictions, key).withColumn("is_match", F.col(label).eqNullSafe(F.col(predicted)))
