"""From raw posts to the star schema: extract features, resolve keys, load."""

from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postmill import schema
from postmill.functions import coerce, stacks, text, vocab
from postmill.operators import dimensions
from postmill.session import staging
from postmill.sources import deadletter
from postmill.sources.tables import Store

FEATURE_FIELDS = (
    "hard_skills", "soft_skills", "nice_to_have", "years_experience",
    "seniority", "salary", "contract_type", "tech_stack",
)


def pending_ids(posts: DataFrame, jobs: DataFrame, limit: int = None) -> DataFrame:
    """Ids of posts that have no job yet, optionally the first few. Only ids are read and exchanged."""
    pending = posts.select("id").join(jobs.select("id"), "id", "left_anti")
    return pending if limit is None else pending.distinct().orderBy("id").limit(limit)


def pending_posts(posts: DataFrame, jobs: DataFrame, limit: int = None) -> DataFrame:
    """Posts that have no job yet, optionally the first few by id."""
    return posts.join(pending_ids(posts, jobs, limit), "id", "left_semi")


def _expandable(expand_partial: bool) -> Column:
    """Stacks whose components count as hard skills."""
    if expand_partial:
        return F.col("_stacks")
    return F.array_union(stacks.complete_stacks(F.col("_canonical")), F.col("_mentioned"))


def with_text_features(
    posts: DataFrame, description: str = "description", expand_partial: bool = True, partitions: int = None
) -> DataFrame:
    """Add `features`, the struct of everything read from the description.

    A narrow transformation: no shuffle of a large input, one Arrow call for
    rows with entities.
    Steps are separate columns so that every regex runs once per row. `partitions`
    deals the rows anew first, for inputs of few files.
    """
    hard_source = text.without_section(F.col("_text"), F.col("_nice_text"))
    steps = (
        ("_text", text.clean(F.col(description))),
        ("_nice_text", text.nice_section(F.col("_text"))),
        ("_hard_raw", text.one_per_canonical(text.technologies(hard_source))),
        ("_nice_raw", text.one_per_canonical(text.technologies(F.col("_nice_text")))),
        ("_nice_raw", text.nice_without_hard(F.col("_nice_raw"), F.col("_hard_raw"))),
        ("_hard", text.labels_of(F.col("_hard_raw"))),
        ("_nice", text.labels_of(F.col("_nice_raw"))),
        ("_canonical", text.canonical_names(F.concat("_hard", "_nice"))),
        ("_mentioned", stacks.mentioned_stacks(F.col("_text"))),
        ("_stacks", F.sort_array(F.array_union(stacks.covered_stacks(F.col("_canonical")), F.col("_mentioned")))),
        ("_expanded", stacks.expand_skills(F.col("_hard"), F.col("_stacks"), _expandable(expand_partial))),
    )
    frame = posts.repartition(partitions) if partitions else posts
    for name, column in steps:
        frame = frame.withColumn(name, column)
    features = F.struct(
        F.col("_expanded").alias("hard_skills"),
        text.soft_skills(F.col("_text")).alias("soft_skills"),
        F.col("_nice").alias("nice_to_have"),
        text.years_experience(F.col("_text")).alias("years_experience"),
        text.seniority(F.col("_text")).alias("seniority"),
        text.salary_mentions(F.col("_text")).alias("salary"),
        text.contract_mentions(F.col("_text")).alias("contract_type"),
        F.col("_stacks").alias("tech_stack"),
    )
    return frame.withColumn("features", features).drop(*{name for name, _ in steps})


#: Parts of a batch that raised, and of each part that raises again.
PARTS = 8


def guarded(function, result: T.StructType):
    """A pandas extractor for `with_custom_features` whose failures cost single rows.

    `function` takes a pandas Series of descriptions and returns a DataFrame with
    the fields of `result`. A batch that raises is tried again in parts, and the parts that
    raise in smaller ones; rows that raise by themselves carry the message in `error`.
    """
    names = result.fieldNames()
    fields = [f for f in result.fields if f.name != "error"] + [T.StructField("error", T.StringType())]

    def of_row(value) -> pd.DataFrame:
        try:
            row = function(pd.Series([value]))[names].iloc[0].to_dict() | {"error": None}
        except Exception as failure:
            row = dict.fromkeys(names) | {"error": f"{type(failure).__name__}: {failure}"}
        return pd.DataFrame([row], columns=[*names, "error"], dtype=object)

    def of_parts(description: pd.Series) -> list:
        step = -(-len(description) // PARTS)
        parts = []
        for start in range(0, len(description), step):
            part = description.iloc[start:start + step].reset_index(drop=True)
            if len(part) == 1:
                parts.append(of_row(part[0]))
                continue
            try:
                found = function(part)[names]
                if len(found) != len(part):
                    raise ValueError("not one row for each description")
                parts.append(found.astype(object).assign(error=None))
            except Exception:
                parts.extend(of_parts(part))
        return parts

    def isolated(description: pd.Series) -> pd.DataFrame:
        try:
            return function(description)[names].assign(error=None)
        except Exception:
            return pd.concat(of_parts(description), ignore_index=True)

    return F.pandas_udf(isolated, T.StructType(fields))


def with_custom_features(posts: DataFrame, extractor, description: str = "description") -> DataFrame:
    """Features from a user function `Column -> Column` (built-ins, a pandas UDF, or `guarded`).

    The function gets '' for a NULL description and returns a struct; fields it
    leaves out are NULL. A field `error` tells why a row failed: it has no
    features then, and goes to the error log with its description.
    """
    given = posts.withColumn("_given", extractor(F.coalesce(description, F.lit(""))))
    # passed through a generator: filters on features would be pushed below joins and run the extractor again, on all rows
    given = given.select(*posts.columns, F.explode(F.array("_given")).alias("_features"))
    have = set(given.schema["_features"].dataType.fieldNames())
    failure = F.col("_features.error") if "error" in have else F.lit(None).cast("string")
    fields = [
        (F.col(f"_features.{f.name}") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.FEATURES.fields
    ]
    sound = F.col("_features").isNotNull() & failure.isNull()
    return given.withColumn("features", F.when(sound, F.struct(*fields))).withColumn(
        "extractor_error", failure
    ).drop("_features")


def _reasons(featured: DataFrame) -> Column:
    """Why a row has no features: the message of the extractor, if it gave one."""
    failure = F.col("extractor_error") if "extractor_error" in featured.columns else F.lit(None).cast("string")
    return F.array_compact(F.array(failure))


def job_fields(featured: DataFrame, extractor_type: str) -> DataFrame:
    """Stored job values, skill-name lists and `reasons` of rows that cannot be stored."""
    have = set(featured.schema["features"].dataType.fieldNames())

    def feature(name):
        return F.col(f"features.{name}") if name in have else F.lit(None).cast(schema.FEATURES[name].dataType)

    amount = coerce.salary_amount(F.get(feature("salary"), F.lit(0)))
    stack = F.when(F.size(feature("tech_stack")) > 0, feature("tech_stack")).otherwise(feature("hard_skills"))
    return featured.where(F.col("features").isNotNull() | (F.size(_reasons(featured)) > 0)).select(
        "id",
        "company_id",
        "career_page_name",
        "description",
        coerce.blank_to_null(F.substring("state", 1, 100)).alias("state"),
        coerce.blank_to_null(F.substring("city", 1, 150)).alias("city"),
        coerce.title(feature("job_title"), F.col("name")).alias("job_title"),
        F.lit(extractor_type).alias("extractor_type"),
        amount.cast("bigint").alias("salary"),
        feature("seniority").alias("seniority"),
        feature("years_experience").alias("years_experience"),
        text.skill_names(stack).alias("tech_stack"),
        coerce.first_contract(feature("contract_type")).alias("contract_type"),
        *[text.skill_names(feature(field)).alias(name) for name, (_, _, field) in schema.SKILL_KINDS.items()],
        _reasons(featured).alias("reasons"),
    )


def good_rows(fields: DataFrame) -> DataFrame:
    return fields.where(F.size("reasons") == 0)


def failed_rows(fields: DataFrame) -> DataFrame:
    """Dead-letter fields: the failure and the description that caused it."""
    return fields.where(F.size("reasons") > 0).select(
        F.format_string("Failed to process job %d: %s", "id", F.array_join("reasons", "; ")).alias("message"),
        F.col("description").alias("payload"),
    )


def _members(kind: str, names: Column) -> Column:
    return F.transform(names, lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name")))


def star_tables(fields: DataFrame, existing: dict, keep=lambda rows, name: rows) -> dict:
    """New rows of every table for rows that passed validation.

    `existing` maps table names to frames. Nothing is collected and every join
    is on a key. `keep` fixes intermediate frames that several tables derive
    from; a load passes `stage`, so that dimensions are computed once.
    """
    new = {}
    wanted = keep(dimensions.new_companies(existing["companies"], fields), "wanted-companies")
    clashing = keep(dimensions.company_name_clashes(existing["companies"], wanted), "clashing-companies")
    new["companies"] = wanted.join(clashing, "id", "left_anti")
    clashing_keys = clashing.select(F.col("id").alias("company_key"))
    keyed = fields.withColumn(
        "company_key", dimensions.company_key(F.col("company_id"), F.col("career_page_name"))
    )
    placed = keyed.join(clashing_keys, "company_key", "left_anti")
    new["rejected_companies"] = keyed.join(clashing_keys, "company_key", "left_semi").select(
        F.format_string("Failed to process job %d: company name is taken", "id").alias("message"),
        F.col("description").alias("payload"),
    )

    # one pass over the rows names the members of every plain dimension
    kinds = ("states", "contract_types", *schema.SKILL_KINDS)
    named = [_members("states", F.array("state")), _members("contract_types", F.array("contract_type"))]
    named += [_members(kind, F.coalesce(kind, F.array().cast("array<string>"))) for kind in schema.SKILL_KINDS]
    names = placed.select(F.explode(F.concat(*named)).alias("m")).select("m.kind", "m.name").where("name is not null")
    names = keep(names.distinct(), "names")
    members = None
    for kind in kinds:
        own = dimensions.new_members(existing[kind], names.where(F.col("kind") == kind).select("name"))
        own = own.select(F.lit(kind).alias("kind"), "id", "name")
        members = own if members is None else members.unionByName(own)
    members = keep(members, "members")
    for kind in kinds:
        new[kind] = members.where(F.col("kind") == kind).drop("kind")
    states = existing["states"].unionByName(new["states"])
    new["cities"] = keep(
        dimensions.new_members(existing["cities"], dimensions.city_names(placed, states), ("name", "state_id")),
        "cities",
    )
    cities = existing["cities"].unionByName(new["cities"])
    contracts = existing["contract_types"].unionByName(new["contract_types"])

    for table, (bridge, skill_id, _) in schema.SKILL_KINDS.items():
        pairs = dimensions.bridge_rows(
            placed.select(F.col("id").alias("job_id"), F.col(table).alias("names")),
            existing[table].unionByName(new[table]),
            skill_id,
        )
        new[bridge] = pairs

    new["jobs"] = (
        placed.join(states.select(F.col("id").alias("state_id"), F.col("name").alias("state")), "state", "left")
        .join(
            cities.select(F.col("id").alias("city_id"), F.col("name").alias("city"), "state_id"),
            ["city", "state_id"],
            "left",
        )
        .join(
            contracts.select(F.col("id").alias("contract_type_id"), F.col("name").alias("contract_type")),
            "contract_type",
            "left",
        )
        .select(
            "id", "job_title", "extractor_type", "salary", "seniority", "years_experience", "tech_stack",
            F.col("company_key").alias("company_id"), "contract_type_id", "state_id", "city_id",
        )
    )
    return new


WRITE_ORDER = schema.STAR
#: Tables of a load that are written at a time.
WRITERS = 4


def extract_and_load(
    store: Store, extractor=None, extractor_type: str = "regex", limit: int = None, posts: DataFrame = None
) -> None:
    """Process all pending posts into the star schema; failures go to the error log.

    All tables are written as one load, which readers see when it is published at the
    end. A run that dies before leaves nothing to be seen, and can be repeated. A
    post is pending while no published load has its job, so bridge rows are new whenever
    their job is. One run at a time may load.
    """
    posts = store.read("jobs_posts") if posts is None else posts
    needed = posts.select(
        "id", "name", "description", "company_id", "career_page_name", "state", "city"
    )
    with staging(store.spark) as stage:
        # written first: few pending ids are then broadcast, and texts of posts long stored are not moved
        ids = stage(pending_ids(needed, store.read("jobs"), limit), "pending-ids")
        pending = needed.join(ids, "id", "left_semi")
        featured = with_text_features(pending) if extractor is None else with_custom_features(pending, extractor)
        fields = stage(job_fields(featured, extractor_type), "job-fields")
        existing = {name: store.read(name) for name in WRITE_ORDER}
        new = star_tables(good_rows(fields), existing, stage)
        failures = stage(failed_rows(fields).unionByName(new["rejected_companies"]), "failures")
        load = store.new_load()
        with ThreadPoolExecutor(WRITERS) as pool:
            # the tables derive from staged frames and published loads only, so their order is free
            for written in [pool.submit(store.append, name, new[name], load) for name in WRITE_ORDER]:
                written.result()
        store.log(deadletter.error_rows(failures, f"{extractor_type}_extractor"))
        store.publish(load)
