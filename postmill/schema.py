"""Fixed schemas of every table the library reads or writes.

Publication times are naive UTC, so they are TIMESTAMP_NTZ: no result depends
on the session time zone.
"""

from pyspark.sql import types as T

LANDED_ROW = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("companyId", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("careerPageId", T.LongType()),
    T.StructField("careerPageName", T.StringType()),
    T.StructField("careerPageLogo", T.StringType()),
    T.StructField("careerPageUrl", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("publishedDate", T.StringType()),
    T.StructField("applicationDeadline", T.StringType()),
    T.StructField("isRemoteWork", T.BooleanType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("jobUrl", T.StringType()),
    T.StructField("workplaceType", T.StringType()),
    T.StructField("disabilities", T.BooleanType()),
    # arrays or objects upstream: kept as their JSON text
    T.StructField("skills", T.StringType()),
    T.StructField("badges", T.StringType()),
])

PAGE = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("data", T.ArrayType(LANDED_ROW)),
    T.StructField("pagination", T.StructType([T.StructField("total", T.LongType())])),
    T.StructField("_corrupt", T.StringType()),
])

# landed name -> stored name, for the columns that are only renamed
LANDED_TO_POST = {
    "id": "id",
    "companyId": "company_id",
    "name": "name",
    "description": "description",
    "careerPageId": "career_page_id",
    "careerPageName": "career_page_name",
    "careerPageLogo": "career_page_logo",
    "careerPageUrl": "career_page_url",
    "type": "job_type",
    "publishedDate": "published_date",
    "applicationDeadline": "application_deadline",
    "isRemoteWork": "is_remote_work",
    "city": "city",
    "state": "state",
    "country": "country",
    "jobUrl": "job_url",
    "workplaceType": "workplace_type",
    "disabilities": "disabilities",
    "skills": "skills",
    "badges": "badges",
}

POST = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("company_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("career_page_id", T.LongType()),
    T.StructField("career_page_name", T.StringType()),
    T.StructField("career_page_logo", T.StringType()),
    T.StructField("career_page_url", T.StringType()),
    T.StructField("job_type", T.StringType()),
    T.StructField("published_date", T.TimestampNTZType()),
    T.StructField("application_deadline", T.DateType()),
    T.StructField("is_remote_work", T.BooleanType()),
    T.StructField("city", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("job_url", T.StringType()),
    T.StructField("workplace_type", T.StringType()),
    T.StructField("disabilities", T.BooleanType()),
    T.StructField("skills", T.StringType()),
    T.StructField("badges", T.StringType()),
])

JOB = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("job_title", T.StringType()),
    T.StructField("extractor_type", T.StringType()),
    T.StructField("salary", T.LongType()),
    T.StructField("seniority", T.StringType()),
    T.StructField("years_experience", T.IntegerType()),
    T.StructField("tech_stack", T.ArrayType(T.StringType())),
    T.StructField("company_id", T.LongType()),
    T.StructField("contract_type_id", T.LongType()),
    T.StructField("state_id", T.LongType()),
    T.StructField("city_id", T.LongType()),
])

DIMENSION = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
])

CITY = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("state_id", T.LongType()),
])

SEARCH_TERM = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("term", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("last_scraped_at", T.TimestampNTZType()),
])

ERROR = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("source", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("term", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("request_limit", T.IntegerType()),
    T.StructField("payload", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

LABELLED = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("hard_skills", T.StringType()),
    T.StructField("soft_skills", T.StringType()),
    T.StructField("salary", T.StringType()),
    T.StructField("level", T.StringType()),
    T.StructField("contract_type", T.StringType()),
])

FEATURES = T.StructType([
    T.StructField("job_title", T.StringType()),
    T.StructField("hard_skills", T.ArrayType(T.StringType())),
    T.StructField("soft_skills", T.ArrayType(T.StringType())),
    T.StructField("nice_to_have", T.ArrayType(T.StringType())),
    T.StructField("years_experience", T.IntegerType()),
    T.StructField("seniority", T.StringType()),
    T.StructField("salary", T.ArrayType(T.StringType())),
    T.StructField("contract_type", T.ArrayType(T.StringType())),
    T.StructField("tech_stack", T.ArrayType(T.StringType())),
    T.StructField("confidence_score", T.DoubleType()),
])


def bridge(skill_id: str) -> T.StructType:
    return T.StructType([
        T.StructField("job_id", T.LongType()),
        T.StructField(skill_id, T.LongType()),
    ])


SKILL_KINDS = {
    # table of names: (bridge table, bridge column, feature field)
    "hard_skills": ("job_hard_skills", "hard_skill_id", "hard_skills"),
    "soft_skills": ("job_soft_skills", "soft_skill_id", "soft_skills"),
    "nice_to_have_skills": ("job_nice_to_have_skills", "nice_to_have_skill_id", "nice_to_have"),
}

#: Tables that a load fills together: readers see all of a load or nothing.
STAR = (
    "companies", "states", "cities", "contract_types", "hard_skills", "soft_skills", "nice_to_have_skills",
    "job_hard_skills", "job_soft_skills", "job_nice_to_have_skills", "jobs",
)

LOAD = T.StructType([
    T.StructField("load", T.StringType()),
    T.StructField("replaces", T.ArrayType(T.StringType())),
])

VERSION = T.StructType([T.StructField("version", T.LongType())])

TABLES = {
    "jobs_posts": POST,
    "jobs": JOB,
    "companies": DIMENSION,
    "contract_types": DIMENSION,
    "states": DIMENSION,
    "cities": CITY,
    "hard_skills": DIMENSION,
    "soft_skills": DIMENSION,
    "nice_to_have_skills": DIMENSION,
    "job_hard_skills": bridge("hard_skill_id"),
    "job_soft_skills": bridge("soft_skill_id"),
    "job_nice_to_have_skills": bridge("nice_to_have_skill_id"),
    "search_terms": SEARCH_TERM,
    "error_logs": ERROR,
}
