"""Job-posting tables derived from the given star-schema and text tables.

Posts are orders with their customer, nation and region; descriptions are
Portuguese adverts whose sections, amounts and durations come from the row, so
the features of every row follow from its columns. The SQL texts state those
expected features directly and never repeat a pattern.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of texts, dealt into the partitions that the session asks for, if it does.

    Tables of one small file are one task; the setting `postmill.partitions`
    spreads them. Without it the scan's own partitions are kept.
    """
    wanted = spark.conf.get("postmill.partitions", None)
    rows = table(spark, sf_dir, name)
    return rows.repartition(int(wanted)) if wanted else rows


def dealt(rows: DataFrame) -> DataFrame:
    """Short rows that cost much time each, dealt evenly over the cores: many of them are one file, or one task of its scan."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


# --- posts -------------------------------------------------------------------

def _case(column: str, values: dict) -> Column:
    result = None
    for key, value in values.items():
        condition = F.col(column) == key
        result = F.when(condition, value) if result is None else result.when(condition, value)
    return result.otherwise("")


_HARD = {
    "1-URGENT": "Python, Django e PostgreSQL",
    "2-HIGH": "React, Node.js e MongoDB",
    "3-MEDIUM": "PHP, MySQL e Linux",
    "4-NOT SPECIFIED": "Java e SQL Server, com git",
    "5-LOW": "JavaScript, TypeScript e HTML5",
}
_NICE = {
    "AUTOMOBILE": "Docker e Kubernetes",
    "BUILDING": "Python e AWS",
    "HOUSEHOLD": "GA e Google Analytics",
    "MACHINERY": "Go, golang e Rust",
}
_SOFT = {
    "O": "Proatividade e boa comunica&ccedil;&atilde;o",
    "F": "trabalho em equipe",
}
_CONTRACT = {
    0: "Contrata&ccedil;&atilde;o: CLT;",
    1: "Contrata&ccedil;&atilde;o: Pessoa Jur&iacute;dica (PJ);",
    2: "Contrata&ccedil;&atilde;o: Est&aacute;gio;",
}
_SENIORITY = {0: "J&uacute;nior", 1: "S&ecirc;nior", 2: "Pleno"}
_WORKPLACE = {"1-URGENT": "remote", "2-HIGH": "hybrid", "3-MEDIUM": "on-site", "5-LOW": "Remote"}


def _years() -> Column:
    low = F.col("o_custkey") % 25
    spread = F.when(
        F.col("o_orderstatus") == "F",
        F.concat(low.cast("string"), F.lit(" a "), (low + 2).cast("string")),
    ).otherwise(F.concat(F.lit("M&iacute;nimo de "), low.cast("string")))
    return F.concat(spread, F.lit(" anos de experi&ecirc;ncia"))


def _salary() -> Column:
    amount = F.translate(F.format_number(F.floor("o_totalprice"), 0), ",", ".")
    return F.when(F.col("o_orderkey") % 5 == 0, "sal&aacute;rio a combinar").otherwise(
        F.concat(F.lit("sal&aacute;rio R$ "), amount, F.lit(",00"))
    )


def _optional(header: str, body: Column) -> Column:
    return F.when(body == "", "").otherwise(F.concat(F.lit(f"<p>{header}: "), body, F.lit(".</p>\n")))


def advert(text_before: Column = None) -> Column:
    """HTML advert of one order row, after an optional introduction."""
    intro = F.lit("") if text_before is None else text_before
    return F.concat(
        F.lit("<div>"), intro,
        F.lit("\n<p>Vaga "), _case("_level", _SENIORITY), F.lit("&nbsp; no segmento <b>"),
        F.col("c_mktsegment"), F.lit("</b></p>\n"),
        F.lit("<p>Requisitos e qualifica&ccedil;&otilde;es: "), _case("o_orderpriority", _HARD),
        F.lit(". "), _years(), F.lit(".</p>\n"),
        _optional("Habilidades Desej&aacute;veis", _case("c_mktsegment", _NICE)),
        _optional("Soft skills", _case("o_orderstatus", _SOFT)),
        F.lit("<p>Informa&ccedil;&otilde;es adicionais: "), _salary(), F.lit(". "),
        _case("_terms", _CONTRACT), F.lit("</p></div>"),
    )


def _order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return (
        text_table(spark, sf_dir, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("_level", F.col("o_orderkey") % 4)
        .withColumn("_terms", F.col("o_custkey") % 4)
    )


def posts(spark: SparkSession, sf_dir: str, spread=lambda rows: rows) -> DataFrame:
    """Raw posts with all stored columns, one per order. `spread` may deal the rows anew before they get their texts."""
    rows = spread(_order_rows(spark, sf_dir))
    unknown = F.lit(None).cast("string")
    return rows.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("company_id"),
        F.concat(F.lit("Vaga "), "o_orderkey").alias("name"),
        advert().alias("description"),
        F.col("o_custkey").alias("career_page_id"),
        F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("Grupo "), "c_mktsegment"))
        .otherwise(F.col("c_name")).alias("career_page_name"),
        unknown.alias("career_page_logo"),
        F.concat(F.lit("https://jobs.example.com/"), "o_custkey").alias("career_page_url"),
        F.col("o_orderstatus").alias("job_type"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("published_date"),
        F.date_add(F.to_date("o_orderdate"), 30).alias("application_deadline"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_remote_work"),
        F.when(F.col("o_orderstatus") != "P", F.col("n_name")).alias("city"),
        F.when(F.col("r_name") != "AFRICA", F.col("r_name")).alias("state"),
        F.lit("Brasil").alias("country"),
        unknown.alias("job_url"),
        F.nullif(_case("o_orderpriority", _WORKPLACE), F.lit("")).alias("workplace_type"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey") % 2 == 0).alias("disabilities"),
        F.concat(F.lit('["'), "o_orderpriority", F.lit('"]')).alias("skills"),
        unknown.alias("badges"),
    )


def long_adverts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as the introduction of an advert, one per document.

    The advert part belongs to the order with the document's number.
    """
    rows = _order_rows(spark, sf_dir)
    return text_table(spark, sf_dir, "documents").join(rows, F.col("doc_id") == F.col("o_orderkey")).select(
        F.col("doc_id").alias("id"), advert(F.col("text")).alias("description")
    )


POSTS_SQL = """
posts AS (
  SELECT o_orderkey AS id, o_custkey AS company_id, 'Vaga ' || o_orderkey AS name,
         CASE WHEN o_custkey % 3 = 0 THEN 'Grupo ' || c_mktsegment ELSE c_name END AS career_page_name,
         o_orderdate AS published_date,
         CASE WHEN o_orderstatus <> 'P' THEN n_name END AS city,
         CASE WHEN r_name <> 'AFRICA' THEN r_name END AS state,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'remote' WHEN '2-HIGH' THEN 'hybrid'
              WHEN '3-MEDIUM' THEN 'on-site' WHEN '5-LOW' THEN 'Remote' END AS workplace_type,
         o_orderstatus, o_orderpriority, c_mktsegment, o_totalprice
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

# the features each advert states, by construction
FEATURES_SQL = """
parts AS (
  SELECT p.*,
    CASE o_orderpriority
      WHEN '1-URGENT' THEN ['Django', 'PostgreSQL', 'Python']
      WHEN '2-HIGH' THEN ['Angular', 'Express.js', 'MEAN', 'MERN', 'MEVN', 'MongoDB', 'Node.js', 'PERN',
                          'PostgreSQL', 'React', 'Vue.js']
      WHEN '3-MEDIUM' THEN ['LAMP', 'LEMP', 'Linux', 'MySQL', 'PHP', 'apache', 'nginx']
      WHEN '4-NOT SPECIFIED' THEN ['Git', 'Java', 'SQL Server']
      ELSE ['HTML5', 'JAMstack', 'JavaScript', 'TypeScript'] END AS stated,
    CASE o_orderpriority
      WHEN '1-URGENT' THEN ['Django'] WHEN '2-HIGH' THEN ['MEAN', 'MERN', 'MEVN', 'PERN']
      WHEN '3-MEDIUM' THEN ['LAMP', 'LEMP'] WHEN '5-LOW' THEN ['JAMstack'] ELSE [] END AS stacks,
    CASE c_mktsegment
      WHEN 'AUTOMOBILE' THEN ['Docker', 'Kubernetes']
      WHEN 'BUILDING' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN ['AWS'] ELSE ['AWS', 'Python'] END
      WHEN 'HOUSEHOLD' THEN ['Google Analytics'] WHEN 'MACHINERY' THEN ['Go', 'Rust'] ELSE [] END AS nice,
    CASE o_orderstatus WHEN 'O' THEN ['comunicação', 'proatividade'] WHEN 'F' THEN ['trabalho em equipe']
      ELSE [] END AS soft,
    CASE WHEN id % 5 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS amount,
    company_id % 25 AS low
  FROM posts p
),
features AS (
  SELECT id, company_id, name, career_page_name, city, state, published_date, amount, stacks,
    list_sort(CASE WHEN amount IS NULL THEN stated ELSE list_append(stated, 'R') END) AS hard, soft, nice,
    CASE WHEN o_orderstatus = 'F' AND low + 2 > 20 THEN NULL
         WHEN low > 20 THEN NULL
         WHEN low > 0 THEN low
         WHEN o_orderstatus = 'F' THEN low + 2 END AS years_experience,
    CASE id % 4 WHEN 0 THEN 'Júnior' WHEN 1 THEN 'Sênior' WHEN 2 THEN 'Pleno' END AS seniority,
    CASE WHEN amount IS NULL THEN 'salário a combinar'
         ELSE 'salário R$ ' || replace(format('{:,}', amount), ',', '.') || ',00' END AS salary,
    CASE company_id % 4 WHEN 1 THEN 'Pessoa Jurídica (PJ)' WHEN 2 THEN 'Estágio' ELSE 'CLT' END AS contract,
    CASE company_id % 4 WHEN 1 THEN 'PJ / Pessoa Jurídica' WHEN 2 THEN 'Estágio' ELSE 'CLT' END AS contract_type
  FROM parts
)"""

WITH_FEATURES = f"WITH {POSTS_SQL}, {FEATURES_SQL}"


# --- a star schema over the given tables -------------------------------------

def star(spark: SparkSession, sf_dir: str) -> dict:
    """Jobs are orders, hard skills are parts, soft skills suppliers, nice-to-have brands."""
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation")
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part")
    home = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey", "n_regionkey"
    )
    jobs = orders.join(home, "o_custkey").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("Vaga "), "o_orderpriority").alias("job_title"),
        F.lit("regex").alias("extractor_type"),
        F.when(F.col("o_orderstatus") != "P", F.floor("o_totalprice").cast("int")).alias("salary"),
        F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("o_orderpriority")).alias("seniority"),
        (F.col("o_orderkey") % 10).cast("int").alias("years_experience"),
        F.array("o_orderpriority", "o_orderstatus").alias("tech_stack"),
        F.col("o_custkey").alias("company_id"),
        F.ascii("o_orderstatus").cast("bigint").alias("contract_type_id"),
        F.col("n_regionkey").cast("bigint").alias("state_id"),
        F.when(F.col("o_orderstatus") != "F", F.col("c_nationkey").cast("bigint")).alias("city_id"),
    )
    return {
        "jobs_posts": orders.select(
            F.col("o_orderkey").alias("id"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("published_date"),
        ),
        "jobs": jobs,
        "companies": customers.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        "contract_types": orders.select(
            F.ascii("o_orderstatus").cast("bigint").alias("id"), F.col("o_orderstatus").alias("name")
        ).distinct(),
        "states": table(spark, sf_dir, "region").select(
            F.col("r_regionkey").cast("bigint").alias("id"), F.col("r_name").alias("name")
        ),
        "cities": nations.select(
            F.col("n_nationkey").cast("bigint").alias("id"),
            F.concat(F.lit("Cidade "), F.col("n_nationkey") % 10).alias("name"),
            F.col("n_regionkey").cast("bigint").alias("state_id"),
        ),
        "hard_skills": parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")),
        "soft_skills": table(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")
        ),
        "nice_to_have_skills": parts.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name")),
        "job_hard_skills": lines.select(
            F.col("l_orderkey").alias("job_id"), F.col("l_partkey").alias("hard_skill_id")
        ),
        "job_soft_skills": lines.select(
            F.col("l_orderkey").alias("job_id"), F.col("l_suppkey").alias("soft_skill_id")
        ),
        "job_nice_to_have_skills": lines.select(
            F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("bigint").alias("nice_to_have_skill_id")
        ),
    }


STAR_SQL = """
jobs AS (
  SELECT o_orderkey AS id, 'Vaga ' || o_orderpriority AS job_title,
         CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice) AS BIGINT) END AS salary,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS seniority,
         o_orderkey % 10 AS years_experience, o_orderpriority || ', ' || o_orderstatus AS tech_stack,
         o_custkey AS company_id, o_orderstatus AS contract_type, n_regionkey AS state_id,
         CASE WHEN o_orderstatus <> 'F' THEN c_nationkey END AS city_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
cities AS (SELECT n_nationkey AS id, 'Cidade ' || (n_nationkey % 10) AS name FROM nation),
named AS (
  SELECT j.*, c_name AS company, c.name AS city, r_name AS state
  FROM jobs j LEFT JOIN customer ON company_id = c_custkey LEFT JOIN cities c ON city_id = c.id
       LEFT JOIN region ON state_id = r_regionkey
)"""
