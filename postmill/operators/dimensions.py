"""Set-based upserts of dimensions, companies, bridges and search terms.

New ids are hashes of the natural key: stable across re-runs, no sequence and
no coordination between tasks. Where two keys have one hash, the later one is hashed again.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def member_id(keys, attempt: int = 0) -> Column:
    """The id of a natural key; later attempts give other ids."""
    return F.xxhash64(*keys) if not attempt else F.xxhash64(*keys, F.lit(attempt))


def checked_ids(existing: DataFrame, new: DataFrame) -> DataFrame:
    """`new` (id, keys) with other ids for the members whose id stands for another key already.

    Of new members with one id the least keeps it, if no stored one has it. The others, of which there is about one in
    10^19 pairs, take the id of a second attempt; only if that were taken too, the job fails.
    """
    keys = [c for c in new.columns if c != "id"]
    stored = existing.select("id")
    per_id = new.groupBy("id").agg(F.sort_array(F.collect_set(F.struct(*keys))).alias("members"))
    taken = per_id.join(stored.withColumn("stored", F.lit(True)).distinct(), "id", "left")
    placed = taken.select(
        F.col("id").alias("wanted"), F.coalesce("stored", F.lit(False)).alias("stored"), F.posexplode("members").alias("place", "member")
    ).select("wanted", (F.col("stored") | (F.col("place") > 0)).alias("late"), "member.*")
    first = placed.where(~F.col("late")).select(F.col("wanted").alias("id"), *keys)
    late = placed.where("late").select(member_id(keys, 1).alias("id"), *keys)
    twice = late.join(stored.unionByName(new.select("id")).distinct().withColumn("twice", F.lit(True)), "id", "left")
    clash = F.raise_error(F.lit("no free id for a key")).cast("boolean")
    return first.unionByName(twice.where(F.when(F.col("twice"), clash).otherwise(True)).select("id", *keys))


def new_members(existing: DataFrame, wanted: DataFrame, keys=("name",)) -> DataFrame:
    """Rows to add so that every wanted key exists."""
    missing = wanted.select(*keys).dropna().distinct().join(existing.select(*keys), list(keys), "left_anti")
    return checked_ids(existing, missing.select(member_id(keys).alias("id"), *keys))


def get_or_create(existing: DataFrame, wanted: DataFrame, keys=("name",)) -> DataFrame:
    return existing.unionByName(new_members(existing, wanted, keys))


def state_names(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("state") != "").select(F.substring("state", 1, 100).alias("name"))


def city_names(posts: DataFrame, states: DataFrame) -> DataFrame:
    """(name, state_id) of every post that has both; a city needs a state."""
    located = posts.where((F.col("state") != "") & (F.col("city") != "")).select(
        F.substring("city", 1, 150).alias("name"), F.substring("state", 1, 100).alias("_state")
    ).distinct()
    return located.join(
        states.select(F.col("id").alias("state_id"), F.col("name").alias("_state")), "_state"
    ).select("name", "state_id")


def _company_name(company_id: Column, posted: Column) -> Column:
    fallback = F.concat(F.lit("Empresa "), F.coalesce(company_id.cast("string"), F.lit("None")))
    return F.substring(F.coalesce(F.when(posted != "", posted), fallback), 1, 255)


def company_key(company_id: Column, posted: Column) -> Column:
    """The company id, or a key generated from the name when the post has none."""
    return F.coalesce(company_id, F.xxhash64(_company_name(company_id, posted)))


def new_companies(existing: DataFrame, posts: DataFrame) -> DataFrame:
    """Companies to add, as if posts were processed in id order.

    A company is named by its first post. Of the companies that want one name,
    the first to appear gets it unless it is already stored; the others get
    their id appended. Deciding who is first is an aggregation per name, and the
    answer is joined back on the company id, which is unique.
    """
    named = posts.select(
        F.col("id").alias("post_id"),
        _company_name(F.col("company_id"), F.col("career_page_name")).alias("wanted"),
        "company_id",
        company_key(F.col("company_id"), F.col("career_page_name")).alias("id"),
    )
    candidates = (
        named.groupBy("id")
        .agg(F.min(F.struct("post_id", "wanted", "company_id")).alias("first"))
        .select("id", "first.*")
        .join(existing.select("id"), "id", "left_anti")
    )
    owners = (
        candidates.groupBy("wanted")
        .agg(F.min(F.struct("post_id", "id")).alias("first"))
        .join(existing.select(F.col("name").alias("wanted")), "wanted", "left_anti")
        .select("first.id", F.lit(True).alias("owner"))
    )
    suffixed = F.substring(
        F.concat("wanted", F.lit(" ("), F.coalesce(F.col("company_id").cast("string"), F.lit("None")), F.lit(")")),
        1, 255,
    )
    return candidates.join(owners, "id", "left").select(
        "id", F.when(F.col("owner"), F.col("wanted")).otherwise(suffixed).alias("name")
    )


def company_name_clashes(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Ids of new companies whose final name is already taken (names are unique)."""
    final = existing.select("name", F.lit(0).alias("rank"), "id").unionByName(
        new.select("name", F.lit(1).alias("rank"), "id")
    )
    keepers = final.groupBy("name").agg(F.min(F.struct("rank", "id")).alias("first")).select("first.id")
    return new.join(keepers, "id", "left_anti").select("id")


def bridge_rows(skill_lists: DataFrame, dimension: DataFrame, skill_id: str) -> DataFrame:
    """Distinct (job, skill) pairs from the stored name list of every job."""
    exploded = skill_lists.select("job_id", F.explode(F.array_distinct("names")).alias("name"))
    return exploded.join(dimension.select(F.col("id").alias(skill_id), "name"), "name").select("job_id", skill_id)


def insert_if_absent(existing: DataFrame, new: DataFrame, keys=("term",), order=("term",)) -> DataFrame:
    """Existing rows plus the new rows whose key is not stored yet; of new rows with one key the first by `order`."""
    keys = list(keys)
    row = F.struct(*[F.col(c) for c in new.columns])
    first = new.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(row, F.struct(*order, row)).alias("_row"))
    fresh = first.select("_row.*").join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def _told(terms: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes with `verdict`: what applying them one after the other in `seq` order makes of each.

    An id is alive after an addition and gone after a deletion, else as stored.
    Additions of a term hold it until their id is deleted; one is refused while
    another row holds the term, and what follows for its id is refused with it.
    """
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    alive_by_op = F.when(F.col("op") == "add", True).when(F.col("op") == "delete", False)
    stored = terms.select("id", F.lit(True).alias("_stored"), F.col("term").alias("_stored_term"))
    placed = changes.join(stored, "id", "left").withColumn(
        "_alive", F.coalesce(F.last(alive_by_op, True).over(before), "_stored", F.lit(False))
    )
    # the life an operation belongs to: 0 is the stored row's, others start with an accepted addition
    starts = (F.col("op") == "add") & ~F.col("_alive")
    placed = placed.withColumn("_life", F.coalesce(F.max(F.when(starts, F.col("seq"))).over(upto), F.lit(-1)))
    ends = placed.where((F.col("op") == "delete") & F.col("_alive")).select("id", "_life", F.col("seq").alias("_end"))
    added = placed.where(starts).select("id", "_life", "term").join(ends, ["id", "_life"], "left")
    held = terms.select("id", "term", F.lit(-1).cast("bigint").alias("_life")).join(
        ends.where("_life = -1"), ["id", "_life"], "left"
    )
    lives = added.unionByName(held.select(*added.columns)).withColumn("_end", F.coalesce("_end", F.lit(2**62)))
    accepted = F.aggregate(
        F.sort_array(F.collect_list(F.struct("_life", "id", "_end"))),
        F.struct(F.lit(-2).cast("bigint").alias("until"), F.array().cast("array<struct<id:bigint,_life:bigint>>").alias("refused")),
        lambda acc, life: F.when(
            (life["_life"] == -1) | (life["_life"] > acc["until"]),
            F.struct(F.greatest(acc["until"], life["_end"]).alias("until"), acc["refused"].alias("refused")),
        ).otherwise(F.struct(
            acc["until"].alias("until"),
            F.concat(acc["refused"], F.array(F.struct(life["id"].alias("id"), life["_life"].alias("_life")))).alias("refused"),
        )),
    )
    refused = lives.groupBy("term").agg(accepted.alias("_fold")).select(F.explode("_fold.refused").alias("_r")).select(
        "_r.*", F.lit(True).alias("_refused")
    )
    judged = placed.join(refused, ["id", "_life"], "left")
    wrong_add = (F.col("op") == "add") & (F.col("_alive") | F.col("_refused").isNotNull())
    unknown = (F.col("op") != "add") & (~F.col("_alive") | F.col("_refused").isNotNull())
    return judged.withColumn(
        "verdict", F.when(wrong_add, "taken").when(unknown, "unknown").otherwise("applied")
    )


def apply_changes(terms: DataFrame, changes: DataFrame) -> DataFrame:
    """Terms after a change set of `add`, `update` and `delete`, applied one after the other.

    `changes` has (seq, op, id, term, is_active) with unique `seq`. Changes that
    cannot apply are left to `rejected_changes`.
    """
    applied = _told(terms, changes).where("verdict = 'applied'")
    last = applied.groupBy("id").agg(
        F.max_by("op", "seq").alias("_op"),
        F.max_by(F.when(F.col("op") == "add", F.col("term")), F.when(F.col("op") == "add", F.col("seq"))).alias("_added"),
        F.max(F.when(F.col("op") == "add", F.col("seq"))).alias("_at"),
    )
    active = (
        applied.join(last.select("id", "_at"), "id")
        .where((F.col("op") == "update") & (F.col("_at").isNull() | (F.col("seq") > F.col("_at"))))
        .groupBy("id").agg(F.max_by("is_active", "seq").alias("_active"))
    )
    state = last.join(active, "id", "left")
    kept = terms.join(state, "id", "left").where("_op is null or (_op <> 'delete' and _added is null)")
    kept = kept.withColumn("is_active", F.coalesce("_active", "is_active")).select(*terms.columns)
    added = state.where("_added is not null and _op <> 'delete'").select(
        "id", F.col("_added").alias("term"), F.coalesce("_active", F.lit(True)).alias("is_active")
    )
    return kept.unionByName(added, allowMissingColumns=True)


def rejected_changes(terms: DataFrame, changes: DataFrame) -> DataFrame:
    """One failure per change that could not apply: unknown ids, and additions of what is there."""
    failed = _told(terms, changes).where("verdict <> 'applied'")
    message = F.when(F.col("verdict") == "taken", "Search term already stored").otherwise("Search term not found")
    return failed.select(message.alias("message"), "term", F.to_json(F.struct("op", "id", "seq")).alias("payload"))
