"""Registered text features, coercions and model responses."""

import re

from pyspark.sql import functions as F

from postmill.catalog.adapter import WITH_FEATURES, dealt, long_adverts, posts, table, text_table
from postmill.functions import coerce, responses, stacks, text, vocab
from postmill.plans.extraction import with_text_features


def _cleaned_posts(spark, sf):
    return posts(spark, sf).select("id", text.clean(F.col("description")).alias("text"))


# --- whole pages and documents ------------------------------------------------

def clean_pages(spark, sf):
    return text_table(spark, sf, "pages").select("page_id", text.clean(F.col("html")).alias("text"))


def page_hosts(spark, sf):
    """Hosts of page URLs; every seventh URL is cut so that it cannot be parsed."""
    pages = text_table(spark, sf, "pages")
    url = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("no url "), "url")).otherwise(F.col("url"))
    return pages.select("page_id", coerce.url_host(url).alias("host"))


def description_prefixes(spark, sf):
    documents = text_table(spark, sf, "documents").where(F.length("text") > 0)
    return documents.select("doc_id", text.prefix(F.col("text")).alias("prefix"))


def document_technologies(spark, sf):
    """Vocabulary hits in whole documents, counted per display label."""
    hits = text_table(spark, sf, "documents").select(
        F.explode(text.technologies(text.clean(F.col("text")))).alias("name")
    )
    return hits.groupBy(text.label(F.col("name")).alias("technology")).agg(F.count("*").alias("mentions"))


def page_technologies(spark, sf):
    hits = text_table(spark, sf, "pages").select(
        F.explode(text.technologies(text.clean(F.col("html")))).alias("name")
    )
    return hits.groupBy(text.canonical(F.col("name")).alias("technology")).agg(F.count("*").alias("mentions"))


# --- features of adverts -----------------------------------------------------

def clean_adverts(spark, sf):
    cleaned = _cleaned_posts(spark, sf)
    return cleaned.select("id", F.md5("text").alias("digest"), F.length("text").alias("size"))


def advert_sections(spark, sf):
    cleaned = _cleaned_posts(spark, sf)
    nice = text.nice_section(F.col("text"))
    return cleaned.select(
        "id",
        nice.alias("nice"),
        text.soft_section(F.col("text")).alias("soft"),
        (F.length("text") - F.length(text.without_section(F.col("text"), nice))).alias("removed"),
    )


def technology_spellings(spark, sf):
    """Hits of an advert in text order, and one spelling per canonical name."""
    hits = _cleaned_posts(spark, sf).select("id", text.technologies(F.col("text")).alias("hits"))
    return hits.select(
        "id",
        F.array_join("hits", ", ").alias("hits"),
        F.array_join(text.labels_of(text.one_per_canonical(F.col("hits"))), ", ").alias("labels"),
    )


# A spelling of every soft-skill pattern, and of every seniority word with the label it stands for.
_SOFT_SPELLINGS = (
    "comunicação clara", "liderança", "trabalho em equipe", "autonomia", "proatividade", "proativo", "organização", "criatividade",
    "inovação", "gestão do tempo", "flexibilidade", "empatia", "adaptabilidade", "colaboração", "mentoria", "resolução de problemas",
    "pensamento crítico", "inteligência emocional", "bom humor", "protagonismo", "senso de dono", "perfil analítico",
)
_SENIORITY_SPELLINGS = (
    ("Estagiário", "Estagiário"), ("Júnior", "Júnior"), ("junior", "Júnior"), ("Jr", "Júnior"), ("Pleno", "Pleno"), ("Pl", "Pleno"),
    ("SÊNIOR", "Sênior"), ("Sr.", "Sênior"), ("especialista", "Especialista"), ("Consultor", "Consultor"), ("Liderança", "Liderança"),
    ("gerente", "Gerente"), ("Diretor", "Diretor"),
)


def _planted(spark, sf, spellings):
    """Sentences about parts, each with one of the spellings in turn."""
    chosen = F.get(F.array(*[F.lit(s) for s in spellings]), (F.col("p_partkey") % len(spellings)).cast("int"))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("Busca-se: "), chosen, F.lit(", para "), "p_name", F.lit(".")).alias("text"))


def _spellings_of(pattern):
    """Texts that a vocabulary pattern stands for: every optional part with and without, white space as one blank."""
    texts, at = [""], 0
    while at < len(pattern):
        if pattern.startswith("(?:", at):
            end = next(i for i in range(at, len(pattern)) if pattern[at : i + 1].count("(") == pattern[at : i + 1].count(")"))
            parts = [s for p in pattern[at + 3 : end].split("|") for s in _spellings_of(p)]
            at = end + 1
        elif pattern[at] == "[":
            end = pattern.index("]", at)
            parts, at = [pattern[at + 1]], end + 1
        elif pattern[at] == "\\":
            parts, at = [{"s": " ", "d": "5"}.get(pattern[at + 1], pattern[at + 1])], at + 2
        else:
            parts, at = [pattern[at]], at + 1
        if pattern[at : at + 1] in ("?", "*"):
            parts, at = ["", *parts], at + 1
        elif pattern[at : at + 1] == "+":
            at += 1
        texts = [t + p for t in texts for p in parts]
    return texts


def _technology_cases():
    """Every spelling of every technology in three cases of letters, with the labels that reading it word by word gives."""
    order = "|".join(f"(?:{p})" for p in vocab.TECHNOLOGIES)
    whole = re.compile(rf"(?<![^\W])(?:{order})(?![^\W])", re.I)
    out = {}
    for spelled in dict.fromkeys(s for p in vocab.TECHNOLOGIES for s in _spellings_of(p)):
        for written in (spelled, spelled.upper(), spelled.lower()):
            keys = [vocab.ALIASES.get(m[0].lower(), m[0].lower()) for m in whole.finditer(written)]
            names = {k: vocab.LABELS.get(k, m[0].upper() if len(m[0]) <= 2 else m[0]) for k, m in zip(keys, whole.finditer(written))}
            out[written] = ", ".join(sorted(names.values()))
    return out


def _labelled(name):
    """The label of an alias or canonical name, by plain lookups; unlisted ones are upper-cased where the query spells them so."""
    return vocab.LABELS[vocab.ALIASES.get(name, name)]


def planted_technologies(spark, sf):
    """Labels of every spelling of every technology, planted in sentences about parts and their sizes."""
    cases = list(_technology_cases())
    chosen = F.get(F.array(*[F.lit(s) for s in cases]), (F.col("p_partkey") % len(cases)).cast("int"))
    sentences = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("Busca-se: "), chosen, F.lit(", para "), F.col("p_size").cast("string")).alias("text"))
    found = text.labels_of(text.one_per_canonical(text.technologies(F.col("text"))))
    return sentences.select("p_partkey", F.array_join(found, ", ").alias("labels"))


def planted_names(spark, sf):
    """Labels of every alias and every canonical name, as a response may spell them."""
    names = [*vocab.ALIASES, *vocab.LABELS]
    chosen = F.get(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names)).cast("int"))
    spelled = F.when(F.col("p_size") % 2 == 0, F.upper(chosen)).otherwise(F.concat(F.lit(" "), chosen))
    return table(spark, sf, "part").select("p_partkey", text.label(spelled).alias("label"))


def planted_soft_skills(spark, sf):
    found = text.soft_skills(F.col("text"))
    return _planted(spark, sf, _SOFT_SPELLINGS).select("p_partkey", F.array_join(found, ", ").alias("soft"))


def planted_seniorities(spark, sf):
    return _planted(spark, sf, [s for s, _ in _SENIORITY_SPELLINGS]).select("p_partkey", text.seniority(F.col("text")).alias("seniority"))


def nice_to_have(spark, sf):
    cleaned = _cleaned_posts(spark, sf).withColumn("nice", text.nice_section(F.col("text")))
    found = cleaned.select(
        "id",
        text.one_per_canonical(text.technologies(text.without_section(F.col("text"), F.col("nice")))).alias("hard"),
        text.one_per_canonical(text.technologies(F.col("nice"))).alias("nice"),
    )
    return found.select(
        "id",
        F.array_join(text.labels_of(text.nice_without_hard(F.col("nice"), F.col("hard"))), ", ").alias("nice"),
    )


def soft_skills(spark, sf):
    return _cleaned_posts(spark, sf).select(
        "id", F.array_join(text.soft_skills(F.col("text")), ", ").alias("soft")
    )


def years_experience(spark, sf):
    return _cleaned_posts(spark, sf).select("id", text.years_experience(F.col("text")).alias("years_experience"))


def salaries(spark, sf):
    mentions = _cleaned_posts(spark, sf).select("id", text.salary_mentions(F.col("text")).alias("salary"))
    return mentions.select(
        "id",
        F.array_join("salary", " | ").alias("salary"),
        coerce.salary_amount(F.get("salary", F.lit(0))).alias("amount"),
    )


def contracts(spark, sf):
    found = _cleaned_posts(spark, sf).select("id", text.contract_mentions(F.col("text")).alias("contract"))
    return found.select(
        "id",
        F.array_join("contract", " | ").alias("contract"),
        coerce.first_contract(F.col("contract")).alias("contract_type"),
    )


def seniorities(spark, sf):
    return _cleaned_posts(spark, sf).select("id", text.seniority(F.col("text")).alias("seniority"))


def _flat_features(frame):
    def joined(name):
        return F.array_join(f"features.{name}", ", ").alias(name)

    return frame.select(
        "id", joined("hard_skills"), joined("soft_skills"), joined("nice_to_have"),
        F.col("features.years_experience").alias("years_experience"),
        F.col("features.seniority").alias("seniority"),
        F.array_join("features.salary", " | ").alias("salary"),
        joined("contract_type"), joined("tech_stack"),
    )


def extracted_features(spark, sf):
    return _flat_features(with_text_features(posts(spark, sf).select("id", "description")))


def extracted_features_of_long_texts(spark, sf):
    """Adverts that open with a whole document."""
    return _flat_features(with_text_features(long_adverts(spark, sf)))


# --- stacks ------------------------------------------------------------------

# three groups of part types to skills that cover stacks fully, half, or not
_SKILLS_OF = "array('mongodb', 'express', if(p_size % 2 = 0, 'react', 'vue'), if(p_size % 3 = 0, 'nodejs', 'php'))"


def stack_coverage(spark, sf):
    skills = table(spark, sf, "part").select("p_partkey", "p_size", F.expr(_SKILLS_OF).alias("skills"))
    return skills.select(
        "p_partkey",
        *[F.round(stacks.coverage(F.col("skills"), s), 4).alias(s.lower()) for s in ("MERN", "MEVN", "LAMP")],
        F.array_join(stacks.complete_stacks(F.col("skills")), ", ").alias("complete"),
        F.array_join(stacks.partial_stacks(F.col("skills")), ", ").alias("partial"),
    )


def stack_mentions(spark, sf):
    """Stack names planted between the words of whole documents."""
    planted = F.concat(
        F.lit("mern T3, next.js  stack; "), "text",
        F.when(F.col("doc_id") % 2 == 0, " JAMstack, Django Stack.").otherwise(" mernx, lamp_stack"),
    )
    found = text_table(spark, sf, "documents").select(
        "doc_id", stacks.mentioned_stacks(text.clean(planted)).alias("mentioned")
    )
    return found.select(
        "doc_id",
        F.array_join("mentioned", ", ").alias("mentioned"),
        F.array_join(F.sort_array(F.array_distinct(stacks.stack_skills(F.col("mentioned")))), ", ").alias("skills"),
    )


def tech_stack_columns(spark, sf):
    featured = with_text_features(posts(spark, sf).select("id", "description"))
    column = stacks.tech_stack(F.col("features.tech_stack"), F.col("features.hard_skills"))
    return featured.select("id", F.array_join(column, ", ").alias("tech_stack"))


def sure_stack_skills(spark, sf):
    """Hard skills when partly covered stacks do not add their components."""
    featured = with_text_features(posts(spark, sf).select("id", "description"), expand_partial=False)
    return featured.select("id", F.array_join("features.hard_skills", ", ").alias("hard_skills"))


# --- coercions ---------------------------------------------------------------

def parsed_timestamps(spark, sf):
    """Event times written in six ISO spellings, some of them broken."""
    ts = F.col("ts")
    spelled = (
        F.when(F.col("event_id") % 6 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(F.col("event_id") % 6 == 1, F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .when(F.col("event_id") % 6 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'-03:00'"))
        .when(F.col("event_id") % 6 == 3, F.date_format(ts, "yyyyMMdd'T'HHmmss'+0530'"))
        .when(F.col("event_id") % 6 == 4, F.date_format(ts, "yyyy-MM"))
        .otherwise(F.date_format(ts, "dd/MM/yyyy"))
    )
    return table(spark, sf, "events").select("event_id", coerce.parse_datetime(spelled).alias("parsed"))


def parsed_dates(spark, sf):
    day = F.col("o_orderdate")
    spelled = (
        F.when(F.col("o_orderkey") % 5 == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(F.col("o_orderkey") % 5 == 1, F.date_format(day, "yyyyMMdd"))
        .when(F.col("o_orderkey") % 5 == 2, F.date_format(day, "yyyy-MM"))
        .when(F.col("o_orderkey") % 5 == 3, F.date_format(day, "yyyy-MM-dd'T'HH"))
        .otherwise("")
    )
    return table(spark, sf, "orders").select("o_orderkey", coerce.parse_date(spelled).alias("parsed"))


def titles(spark, sf):
    """Extracted title, else posted name, else a constant, cut to 255 characters."""
    extracted = F.when(F.col("doc_id") % 3 == 0, F.col("text"))
    posted = F.when(F.col("doc_id") % 3 == 1, F.col("source")).otherwise("")
    return text_table(spark, sf, "documents").select("doc_id", coerce.title(extracted, posted).alias("title"))


def tidy_lists(spark, sf):
    """Comma lists with blanks and repeats in another case."""
    written = F.concat(F.lit(" "), "p_name", F.lit(",, "), "p_brand", F.lit(" ,"), F.upper("p_name"), F.lit(", "))
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(coerce.split_list(written), "|").alias("items")
    )


def coerced_numbers(spark, sf):
    parts = table(spark, sf, "part")
    return parts.select(
        "p_partkey",
        coerce.digits_to_int(F.concat(F.lit("de "), "p_size", F.lit(" a 7 anos"))).alias("digits"),
        coerce.digits_to_int(F.col("p_name")).alias("no_digits"),
        coerce.text_to_double(F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice").cast("string")).otherwise(
            F.concat(F.col("p_size"), F.lit("d")))).alias("number"),
    )


def model_responses(spark, sf):
    """Model responses built from parts: lists, scalars, numbers, nulls and broken JSON."""
    response = F.when(F.col("p_partkey") % 9 == 0, "{broken").otherwise(F.concat(
        F.lit('{"job_title": "'), "p_name", F.lit('", "salary": '),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size"), F.lit("000.0")))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('"R$ '), "p_size", F.lit('.500,00"')))
        .otherwise("null"),
        F.lit(', "nivel": "Pleno", "contrato": "PJ, clt, pj", "hard_skills": ["'), "p_brand", F.lit('", "sql", "SQL", null],'),
        F.lit(' "soft_skills": null, "nice_to_have": "'), "p_type", F.lit('", "experiencia_anos": '),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"'), "p_size", F.lit(' anos"')))
        .otherwise(F.concat(F.col("p_size"), F.lit(".9"))),
        F.lit(', "confidence_score": "0.75"}'),
    ))
    features = dealt(table(spark, sf, "part")).select("p_partkey", responses.response_features(response).alias("f"))
    joined = [F.array_join(f"f.{c}", ", ").alias(c) for c in
              ("salary", "contract_type", "hard_skills", "soft_skills", "nice_to_have")]
    return features.select(
        "p_partkey", "f.job_title", "f.seniority", "f.years_experience", "f.confidence_score", *joined
    )


def stored_lists(spark, sf):
    """JSON lists, and text that is none, as arrays."""
    stored = (
        F.when(F.col("event_id") % 3 == 0, F.to_json(F.array("event_type", F.col("user_id").cast("string"))))
        .when(F.col("event_id") % 3 == 1, F.col("props"))
        .otherwise("")
    )
    return table(spark, sf, "events").select(
        "event_id", F.array_join(coerce.stored_list(stored), "|").alias("items")
    )


_VOCABULARY_SQL = """
tokens AS (SELECT lower(w) AS w FROM (
  SELECT unnest(regexp_split_to_array({text}, '[^\\pL\\pN_]+')) AS w FROM {table})),
names(w, label, canonical) AS (VALUES ('rest', 'REST API', 'rest-api'), ('ga', 'Google Analytics', 'google-analytics'),
  ('apache', 'Apache', 'apache'), ('r', 'R', 'r'))"""

_CLEAN_PAGE_SQL = r"""
trim(regexp_replace(regexp_replace(
  regexp_replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g'),
  '<[^>]+>|&[a-z]+;', ' ', 'g'), '\s+', ' ', 'g'))"""

_JOINED = """array_to_string(hard, ', ') AS hard_skills, array_to_string(soft, ', ') AS soft_skills,
       array_to_string(nice, ', ') AS nice_to_have, years_experience, seniority, salary,
       contract AS contract_type, array_to_string(stacks, ', ') AS tech_stack"""

QUERIES = [
    ("clean_pages", clean_pages, f"SELECT page_id, {_CLEAN_PAGE_SQL} AS text FROM pages"),
    ("page_hosts", page_hosts, r"""
SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'Direct'
                ELSE lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) END AS host FROM pages"""),
    ("description_prefixes", description_prefixes,
     "SELECT doc_id, substring(text, 1, 1500) AS prefix FROM documents WHERE length(text) > 0"),
    ("document_technologies", document_technologies, f"""
WITH {_VOCABULARY_SQL.format(text="text", table="documents")}
SELECT label AS technology, count(*) AS mentions FROM tokens JOIN names USING (w) GROUP BY 1"""),
    ("page_technologies", page_technologies, f"""
WITH cleaned AS (SELECT {_CLEAN_PAGE_SQL} AS text FROM pages),
{_VOCABULARY_SQL.format(text="text", table="cleaned")}
SELECT canonical AS technology, count(*) AS mentions FROM tokens JOIN names USING (w) GROUP BY 1"""),
]

_ADVERT_TEXT_SQL = """
adverts AS (SELECT f.id, 'Vaga ' || CASE WHEN seniority IS NULL THEN '' ELSE seniority || ' ' END ||
  'no segmento ' || c_mktsegment || ' Requisitos e qualificações: ' ||
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Python, Django e PostgreSQL' WHEN '2-HIGH' THEN 'React, Node.js e MongoDB'
    WHEN '3-MEDIUM' THEN 'PHP, MySQL e Linux' WHEN '4-NOT SPECIFIED' THEN 'Java e SQL Server, com git'
    ELSE 'JavaScript, TypeScript e HTML5' END || '. ' ||
  CASE WHEN o_orderstatus = 'F' THEN low || ' a ' || (low + 2) ELSE 'Mínimo de ' || low END ||
  ' anos de experiência. ' ||
  CASE WHEN nice_text <> '' THEN 'Habilidades Desejáveis' || nice_text || ' ' ELSE '' END ||
  CASE WHEN soft_text <> '' THEN 'Soft skills' || soft_text || ' ' ELSE '' END ||
  'Informações adicionais: ' || salary || '.' ||
  CASE WHEN p.company_id % 4 = 3 THEN '' ELSE ' Contratação: ' || contract || ';' END AS text,
  nice_text, soft_text, o_orderpriority, c_mktsegment, p.amount
FROM features f JOIN (SELECT *,
  CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ': Docker e Kubernetes.' WHEN 'BUILDING' THEN ': Python e AWS.'
    WHEN 'HOUSEHOLD' THEN ': GA e Google Analytics.' WHEN 'MACHINERY' THEN ': Go, golang e Rust.' ELSE '' END AS nice_text,
  CASE o_orderstatus WHEN 'O' THEN ': Proatividade e boa comunicação.' WHEN 'F' THEN ': trabalho em equipe.'
    ELSE '' END AS soft_text FROM parts) p ON p.id = f.id)"""

QUERIES += [
    ("clean_adverts", clean_adverts, f"""
{WITH_FEATURES}, {_ADVERT_TEXT_SQL} SELECT id, md5(text) AS digest, length(text) AS size FROM adverts"""),
    ("advert_sections", advert_sections, f"""
{WITH_FEATURES}, {_ADVERT_TEXT_SQL}
SELECT id, nice_text AS nice, soft_text AS soft, length(nice_text) AS removed FROM adverts"""),
    ("technology_spellings", technology_spellings, f"""
{WITH_FEATURES}, {_ADVERT_TEXT_SQL},
hits AS (SELECT id, list_concat(list_concat(
    CASE o_orderpriority WHEN '1-URGENT' THEN ['Python', 'Django', 'PostgreSQL'] WHEN '2-HIGH' THEN ['React', 'Node.js', 'MongoDB']
      WHEN '3-MEDIUM' THEN ['PHP', 'MySQL', 'Linux'] WHEN '4-NOT SPECIFIED' THEN ['Java', 'SQL Server', 'git']
      ELSE ['JavaScript', 'TypeScript', 'HTML5'] END,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['Docker', 'Kubernetes'] WHEN 'BUILDING' THEN ['Python', 'AWS']
      WHEN 'HOUSEHOLD' THEN ['GA', 'Google Analytics'] WHEN 'MACHINERY' THEN ['Go', 'golang', 'Rust'] ELSE [] END),
    CASE WHEN amount IS NULL THEN [] ELSE ['R'] END) AS hits FROM adverts)
SELECT id, array_to_string(hits, ', ') AS hits, array_to_string(list_sort(list_distinct(list_transform(hits,
  lambda x: CASE x WHEN 'golang' THEN 'Go' WHEN 'GA' THEN 'Google Analytics' WHEN 'git' THEN 'Git' ELSE x END))), ', ') AS labels
FROM hits"""),
    ("nice_to_have", nice_to_have, f"{WITH_FEATURES} SELECT id, array_to_string(nice, ', ') AS nice FROM features"),
    ("soft_skills", soft_skills, f"{WITH_FEATURES} SELECT id, array_to_string(soft, ', ') AS soft FROM features"),
    ("planted_technologies", planted_technologies, f"""
SELECT p_partkey, ([{", ".join("'" + labels + "'" for labels in _technology_cases().values())}])[p_partkey % {len(_technology_cases())} + 1] AS labels
FROM part"""),
    ("planted_names", planted_names, f"""
SELECT p_partkey, ([{", ".join("'" + _labelled(n) + "'" for n in (*vocab.ALIASES, *vocab.LABELS))}])[p_partkey % {len(vocab.ALIASES) + len(vocab.LABELS)} + 1] AS label
FROM part"""),
    ("planted_soft_skills", planted_soft_skills, f"""
SELECT p_partkey, ([{", ".join(f"'{s}'" for s in _SOFT_SPELLINGS)}])[p_partkey % {len(_SOFT_SPELLINGS)} + 1] AS soft FROM part"""),
    ("planted_seniorities", planted_seniorities, f"""
SELECT p_partkey, ([{", ".join(f"'{s}'" for _, s in _SENIORITY_SPELLINGS)}])[p_partkey % {len(_SENIORITY_SPELLINGS)} + 1] AS seniority
FROM part"""),
    ("years_experience", years_experience, f"{WITH_FEATURES} SELECT id, years_experience FROM features"),
    ("salaries", salaries, f"{WITH_FEATURES} SELECT id, salary, amount FROM features"),
    ("contracts", contracts, f"{WITH_FEATURES} SELECT id, contract, contract_type FROM features"),
    ("seniorities", seniorities, f"{WITH_FEATURES} SELECT id, seniority FROM features"),
    ("extracted_features", extracted_features, f"{WITH_FEATURES} SELECT id, {_JOINED} FROM features"),
    ("extracted_features_of_long_texts", extracted_features_of_long_texts, f"""
{WITH_FEATURES},
tokens AS (SELECT doc_id, lower(unnest(regexp_split_to_array(text, '[^\\pL\\pN_]+'))) AS w FROM documents),
found AS (SELECT doc_id, list_sort(list_distinct(list(CASE w WHEN 'rest' THEN 'REST API' WHEN 'ga' THEN 'Google Analytics'
    WHEN 'apache' THEN 'Apache' WHEN 'r' THEN 'R' END))) AS names
  FROM tokens WHERE w IN ('rest', 'ga', 'apache', 'r') GROUP BY 1),
merged AS (SELECT f.* REPLACE (
    list_sort(list_distinct(list_concat(hard, coalesce(names, [])))) AS hard,
    list_filter(nice, lambda x: NOT list_contains(coalesce(names, []), x)) AS nice)
  FROM features f JOIN documents d ON d.doc_id = f.id LEFT JOIN found ON found.doc_id = f.id)
SELECT id, {_JOINED} FROM merged"""),
    ("stack_coverage", stack_coverage, """
SELECT p_partkey,
  (2 + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END) / 4 AS mern,
  (2 + CASE WHEN p_size % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END) / 4 AS mevn,
  CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE 0.25 END AS lamp,
  CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'MERN' ELSE 'MEVN' END ELSE '' END AS complete,
  CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'MEAN, MEVN, PERN' ELSE 'MEAN, MERN, PERN' END
       ELSE CASE WHEN p_size % 2 = 0 THEN 'MEAN, MERN, MEVN, PERN' ELSE 'MEAN, MERN, MEVN' END END AS partial
FROM part"""),
    ("stack_mentions", stack_mentions, """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'DJANGO, JAMSTACK, MERN, NEXT.js, T3' ELSE 'MERN, NEXT.js, T3' END AS mentioned,
  'Express.js, MongoDB, Next.js, Node.js, React, Tailwind CSS, TypeScript, nextauth, prisma, trpc' AS skills
FROM documents"""),
    ("tech_stack_columns", tech_stack_columns, f"""
{WITH_FEATURES} SELECT id, array_to_string(CASE WHEN len(stacks) > 0 THEN stacks ELSE hard END, ', ') AS tech_stack
FROM features"""),
    ("sure_stack_skills", sure_stack_skills, f"""
{WITH_FEATURES}
SELECT f.id, array_to_string(CASE o_orderpriority
    WHEN '2-HIGH' THEN list_filter(hard, lambda x: NOT list_contains(['Angular', 'Express.js', 'PostgreSQL', 'Vue.js'], x))
    WHEN '3-MEDIUM' THEN list_filter(hard, lambda x: NOT list_contains(['apache', 'nginx'], x))
    ELSE hard END, ', ') AS hard_skills
FROM features f JOIN posts p ON p.id = f.id"""),
    ("parsed_timestamps", parsed_timestamps, """
SELECT event_id, CASE event_id % 6 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN ts
    WHEN 2 THEN date_trunc('second', ts) + INTERVAL 3 HOUR
    WHEN 3 THEN date_trunc('second', ts) - INTERVAL 330 MINUTE END AS parsed
FROM events"""),
    ("parsed_dates", parsed_dates, """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders"""),
    ("titles", titles, """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN coalesce(nullif(substring(text, 1, 255), ''), 'Vaga sem título')
    WHEN 1 THEN source ELSE 'Vaga sem título' END AS title FROM documents"""),
    ("tidy_lists", tidy_lists, "SELECT p_partkey, p_name || '|' || p_brand AS items FROM part"),
    ("coerced_numbers", coerced_numbers, """
SELECT p_partkey, CAST(p_size || '7' AS INTEGER) AS digits, CAST(NULL AS INTEGER) AS no_digits,
       CASE WHEN p_size % 2 = 0 THEN p_retailprice END AS number FROM part"""),
    ("model_responses", model_responses, """
SELECT p_partkey, CASE WHEN ok THEN p_name END AS job_title, CASE WHEN ok THEN 'Pleno' END AS seniority,
       CASE WHEN ok THEN p_size END AS years_experience, CASE WHEN ok THEN 0.75 END AS confidence_score,
       CASE WHEN NOT ok THEN NULL WHEN p_partkey % 3 = 0 THEN p_size || '000'
            WHEN p_partkey % 3 = 1 THEN 'R$ ' || p_size || '.500,00' END AS salary,
       CASE WHEN ok THEN 'PJ, clt' ELSE '' END AS contract_type,
       CASE WHEN ok THEN p_brand || ', sql, None' ELSE '' END AS hard_skills, '' AS soft_skills,
       CASE WHEN ok THEN p_type ELSE '' END AS nice_to_have
FROM (SELECT *, p_partkey % 9 <> 0 AS ok FROM part)"""),
    ("stored_lists", stored_lists, """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || '|' || user_id WHEN 1 THEN props END AS items
FROM events"""),
]
