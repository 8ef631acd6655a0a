"""Search, filters, sorting and paging over posts, jobs, terms and errors.

Dimension joins carry no broadcast hint: Spark compares the side's size with
its threshold (at planning time and again at run time) and falls back to a
shuffled join that AQE splits on skew.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postmill import schema
from postmill.session import stage

POST_SORTS = {
    "id": "id",
    "name": "name",
    "company": "career_page_name",
    "published_date": "published_date",
    "workplace_type": "workplace_type",
}

JOB_SORTS = {
    "id": "id",
    "title": "job_title",
    "company": "company",
    "salary": "salary",
    "location": "city",
}


def clamp(value, default: int, low: int = 1, high: int = None) -> int:
    value = default if value is None else int(value)
    return max(low, value if high is None else min(value, high))


def page_arguments(page=None, page_size=None):
    """A request's page number, from 1 up, and page size, kept within 1..100. The operators take any size."""
    return clamp(page, 1), clamp(page_size, 20, high=100)


def sort_direction(order: str = "desc") -> str:
    return "asc" if (order or "").lower() == "asc" else "desc"


# --- filters -----------------------------------------------------------------

def matches_any(needle: str, *columns: str) -> Column:
    """Case-insensitive search in any column; `%` and `_` in the text stay wildcards."""
    pattern = f"%{needle.strip()}%"
    return reduce(lambda a, b: a | b, [F.col(c).ilike(pattern) for c in columns])


def filter_posts(posts: DataFrame, search: str = None, workplace_type: str = None) -> DataFrame:
    if search:
        posts = posts.where(matches_any(search, "name", "career_page_name", "city", "state"))
    if workplace_type:
        posts = posts.where(F.col("workplace_type").ilike(workplace_type.strip()))
    return posts


def filter_jobs(named_jobs: DataFrame, search: str = None, location: str = None) -> DataFrame:
    """Jobs must carry the resolved company, city and state names."""
    if search:
        named_jobs = named_jobs.where(matches_any(search, "job_title", "company", "city", "state"))
    if location:
        named_jobs = named_jobs.where(matches_any(location, "city", "state"))
    return named_jobs


def filter_terms(
    terms: DataFrame, include_inactive: bool = False, search: str = None, status: str = None
) -> DataFrame:
    if not include_inactive and status != "inactive":
        terms = terms.where("is_active")
    if status == "active":
        terms = terms.where("is_active")
    elif status == "inactive":
        terms = terms.where("not is_active")
    if search:
        terms = terms.where(matches_any(search, "term"))
    return terms


def filter_errors(errors: DataFrame, search: str = None, source: str = None) -> DataFrame:
    if source:
        errors = errors.where(F.col("source") == source)
    if search:
        errors = errors.where(matches_any(search, "message", "source", "term"))
    return errors


def lookup(rows: DataFrame, key: int, what: str = "row") -> DataFrame:
    """The row with this id; running the result fails when there is none."""
    found = rows.where(F.col("id") == key).limit(1)
    counted = found.groupBy().agg(F.count("*").alias("n"), F.first(F.struct(*rows.columns)).alias("row"))
    missing = F.raise_error(F.lit(f"{what} with id {key} not found"))
    checked = counted.select(F.when(F.col("n") > 0, F.col("row")).otherwise(missing).alias("row"))
    return checked.select("row.*")


# --- names -------------------------------------------------------------------

def _named(dimension: DataFrame, key: str, name: str) -> DataFrame:
    return dimension.select(F.col("id").alias(key), F.col("name").alias(name))


def with_location_names(jobs: DataFrame, companies: DataFrame, cities: DataFrame, states: DataFrame) -> DataFrame:
    """Company, city and state names, as needed for searching and sorting."""
    return (
        jobs.join(_named(companies, "company_id", "company"), "company_id", "left")
        .join(_named(cities, "city_id", "city"), "city_id", "left")
        .join(_named(states, "state_id", "state"), "state_id", "left")
    )


def with_names(
    jobs: DataFrame, companies: DataFrame, contract_types: DataFrame, states: DataFrame, cities: DataFrame
) -> DataFrame:
    located = with_location_names(jobs, companies, cities, states)
    return located.join(_named(contract_types, "contract_type_id", "contract_type"), "contract_type_id", "left")


def skill_lists(bridge: DataFrame, skills: DataFrame, skill_id: str, name: str) -> DataFrame:
    """Sorted skill names per job. A job has a bounded number of skills."""
    return (
        bridge.join(_named(skills, skill_id, "skill"), skill_id)
        .groupBy("job_id")
        .agg(F.sort_array(F.collect_list("skill")).alias(name))
    )


def with_skill_lists(jobs: DataFrame, bridges: dict, skills: dict) -> DataFrame:
    """The three skill lists of every job; jobs without skills get empty lists."""
    for table, (bridge_name, skill_id, _) in schema.SKILL_KINDS.items():
        names = skill_lists(bridges[bridge_name], skills[table], skill_id, table)
        jobs = jobs.join(names.withColumnRenamed("job_id", "id"), "id", "left").withColumn(
            table, F.coalesce(table, F.array().cast("array<string>"))
        )
    return jobs


# --- order and pages ---------------------------------------------------------

def ordering(sort: str, sorts: dict, default: str, order: str = "desc"):
    """Sort key with NULLs last both ways, id as tie-break in the same direction."""
    column = sorts.get(sort, sorts[default])
    if sort_direction(order) == "asc":
        return [F.col(column).asc_nulls_last(), F.col("id").asc()]
    return [F.col(column).desc_nulls_last(), F.col("id").desc()]


def post_ordering(sort: str = "published_date", order: str = "desc"):
    return ordering(sort, POST_SORTS, "published_date", order)


def job_ordering(sort: str = "id", order: str = "desc"):
    return ordering(sort, JOB_SORTS, "id", order)


def error_ordering():
    return [F.col("created_at").desc(), F.col("id").desc()]


def term_ordering():
    return [F.col("id").desc()]


def page_of(rows: DataFrame, order_by, page: int = 1, page_size: int = 20) -> DataFrame:
    """One page by offset, of exactly the size asked for: a distributed top-n of offset + size rows.

    For deep pages use `page_after`, or `page_at_depth` where no earlier row is known.
    """
    return rows.orderBy(*order_by).offset((page - 1) * page_size).limit(page_size)


def page_after(rows: DataFrame, column: str, last_value, last_id: int, order: str = "desc", page_size: int = 20) -> DataFrame:
    """The page after a known row. Cost does not grow with depth, unlike an offset."""
    key, ident = F.col(column), F.col("id")
    ascending = sort_direction(order) == "asc"
    later_id = ident > last_id if ascending else ident < last_id
    if column == "id":
        rest = later_id
    elif last_value is None:
        rest = key.isNull() & later_id
    else:
        value = F.lit(last_value)
        beyond = key > value if ascending else key < value
        rest = beyond | ((key == value) & later_id) | key.isNull()
    order_by = (
        [key.asc_nulls_last(), ident.asc()] if ascending else [key.desc_nulls_last(), ident.desc()]
    )
    return rows.where(rest).orderBy(*order_by).limit(page_size)


def page_at_depth(
    rows: DataFrame, column: str, order: str = "desc", page: int = 1, page_size: int = 20, partitions: int | None = None
) -> DataFrame:
    """One page by offset at any depth, in the order of `ordering` by `column`; no task sorts more than a range of rows.

    Only the sort key and the id are dealt into ranges, and written once, so that counts and ranks see the same
    ones. Counts per range tell which of them hold the page, and only those are sorted. `id` must be unique.
    """
    spark = rows.sparkSession
    by = ordering(column, {column: column}, column, order)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = rows.select(*dict.fromkeys([column, "id"]))
    placed = stage(keys.repartitionByRange(partitions, *by).withColumn("_part", F.spark_partition_id()), "page-keys")
    # as many rows as there are ranges
    counts = sorted((row._part, row["count"]) for row in placed.groupBy("_part").count().collect())
    start, before, parts, skipped = (page - 1) * page_size, 0, [], 0
    for part, n in counts:
        if before + n <= start:
            skipped = before + n
        elif before < start + page_size:
            parts.append(part)
        before += n
    inside = placed.where(F.col("_part").isin(parts)).orderBy(*by).offset(start - skipped).limit(page_size)
    return rows.join(inside.select("id"), "id", "left_semi").orderBy(*by)


def page_info(rows: DataFrame, page: int = 1, page_size: int = 20) -> DataFrame:
    """One row of paging metadata for a filtered frame."""
    counted = rows.agg(F.count("*").alias("total_items"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_items") / page_size)).cast("bigint")
    return counted.select(
        F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        "total_items",
        pages.alias("total_pages"),
        (F.lit(page) < pages).alias("has_next"),
        F.lit(page > 1).alias("has_prev"),
    )
