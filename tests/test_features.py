"""Worked examples of the text features and coercions."""

import random
import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from postmill.functions import coerce, responses, stacks, text, vocab
from postmill.plans.extraction import with_text_features


def one(spark, value, function, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(function(F.col("v")).alias("r")).first()["r"]


def features(spark, description):
    frame = spark.createDataFrame([(1, description)], "id bigint, description string")
    return with_text_features(frame).select("features.*").first()


@pytest.mark.parametrize("value, expected", [
    ("De R$ 30.000 até R$ 40.000", 30000),
    ("a combinar", None),
    ("", None),
    (None, None),
    ("R$ 30000", 30000),
    ("R$ 4.500,75", 4500),
    ("5000.0", 50000),
    ("R$ 99.999.999.999", 99999999999),
])
def test_salary_amount(spark, value, expected):
    assert one(spark, value, coerce.salary_amount) == expected


@pytest.mark.parametrize("value, expected", [
    ("Pede no mínimo de 3 anos de experiência em dados", 3),
    ("2 a 5 anos de experiência com Java", 2),
    ("0 a 2 anos de experiência", 2),
    ("0 anos de experiência", None),
    ("30 anos de experiência no mercado; 4 anos de experiência na função", 4),
    ("18 a 25 anos de experiência", None),
    ("99999999999999 anos de experiência", None),
    ("5+ anos de experiencia", 5),
    ("sem números", None),
    # the context after "com" swallows a later mention
    ("25 anos de experiência com 3 anos de experiência", None),
])
def test_years(spark, value, expected):
    assert one(spark, value, text.years_experience) == expected


@pytest.mark.parametrize("value, expected", [
    ("Contratação: Pessoa Jurídica (PJ)", ["Pessoa Jurídica (PJ)"]),
    ("contratacao : CLT; Contratação: Estágio\n", ["CLT", "Estágio"]),
    ("CONTRATAÇÃO: PJ", ["CLT"]),
    ("nada", ["CLT"]),
])
def test_contracts(spark, value, expected):
    assert one(spark, value, text.contract_mentions) == expected


@pytest.mark.parametrize("value, expected", [
    ("Analista jr. de dados", "Júnior"),
    ("SÊNIOR ou pleno", "Sênior"),
    ("gerente de projetos", "Gerente"),
    ("lideranca técnica", "Lideranca"),
    ("juniorado", None),
])
def test_seniority(spark, value, expected):
    assert one(spark, value, text.seniority) == expected


@pytest.mark.parametrize("value, expected", [
    ("<div>Vaga&nbsp;de <b>dados</b> &eacute; aqui​!</div>", "Vaga de dados é aqui !"),
    ("a &amp;lt; b &amp; c", "a b & c"),
    ("\x1cum\x1f dois três ", "um dois três"),
    (None, ""),
])
def test_clean(spark, value, expected):
    assert one(spark, value, text.clean) == expected


@pytest.mark.parametrize("value, expected", [
    ("React Native, React e ReactJS", ["React Native", "React", "ReactJS"]),
    ("C#, .NET e go; mongo", ["C#", ".NET", "go"]),
    ("JavaScripts e xPython não contam, HTML5 sim", ["HTML5"]),
    ("CI/CD ci-cd e APIs REST", ["CI/CD", "ci-cd", "APIs REST"]),
    ("Ruby on Rails", ["Ruby", "Rails"]),
])
def test_technologies(spark, value, expected):
    assert one(spark, value, text.technologies) == expected


def test_labels(spark):
    names = ["golang", "k8s", "qa", "Postgres", "Tomcat", " js "]
    got = one(spark, names, lambda c: F.transform(c, text.label), "array<string>")
    assert got == ["Go", "k8s", "QA", "PostgreSQL", "Tomcat", "JavaScript"]


def test_longest_spelling_wins(spark):
    got = one(spark, ["html5", "HTML5", "go", "golang"], text.one_per_canonical, "array<string>")
    assert sorted(got) == ["HTML5", "golang"]


def test_sections_keep_lists_apart(spark):
    row = features(spark, "Requisitos: Python e SQL Server.\nDesejável: Docker, Python e Kubernetes.\nSoft skills: empatia")
    assert row.hard_skills == ["Python", "SQL Server"]
    assert row.nice_to_have == ["Docker", "Kubernetes"]
    assert row.soft_skills == ["empatia"]


def test_whole_advert(spark):
    row = features(spark, """
        <p>Somos uma empresa de logística com foco em inovação.</p>
        Atividades: manter serviços em Node.js com Express e MongoDB; publicar com Docker e GitHub Actions.
        Requisitos e qualificações: TypeScript, React, Git; 3 a 5 anos de experiência com web.
        Diferenciais: Kubernetes, react. Informações adicionais: bolsa de R$ 2.500,00. Contratação: Estágio;
    """)
    assert row.hard_skills == [
        "Angular", "Docker", "Express.js", "Git", "GitHub Actions", "MEAN", "MERN", "MEVN", "MongoDB", "Node.js",
        "PERN", "PostgreSQL", "R", "React", "TypeScript", "Vue.js",
    ]
    assert row.nice_to_have == ["Kubernetes"]
    assert row.soft_skills == ["inovação"]
    assert row.years_experience == 3
    assert row.seniority is None
    assert row.salary == ["bolsa de R$ 2.500,00"]
    assert row.contract_type == ["Estágio"]
    assert row.tech_stack == ["MEAN", "MERN", "MEVN", "PERN"]


def test_mentioned_stacks_expand_only_in_their_own_spelling(spark):
    row = features(spark, "Experiência com stack MERN e Next.js stack")
    assert row.tech_stack == ["MERN", "NEXT.js"]
    assert row.hard_skills == ["Express.js", "MERN", "MongoDB", "NEXT.js", "Next.js", "Node.js", "React"]


def test_empty_description(spark):
    row = features(spark, None)
    assert (row.hard_skills, row.soft_skills, row.salary, row.contract_type) == ([], [], None, ["CLT"])


@pytest.mark.parametrize("names, complete, partial", [
    (["linux", "mysql", "php"], [], ["LAMP", "LEMP"]),
    (["python"], [], []),
    (["javascript"], ["JAMstack"], []),
    (["typescript", "nextjs", "tailwindcss"], [], []),
    (["typescript", "nextjs", "prisma"], [], ["T3"]),
])
def test_stacks(spark, names, complete, partial):
    assert one(spark, names, stacks.complete_stacks, "array<string>") == complete
    assert one(spark, names, stacks.partial_stacks, "array<string>") == partial


@pytest.mark.parametrize("value, expected", [
    (None, None), ("", None), ("ontem", None), ("2026-04", None), ("2026-02-30T10:00:00", None),
    ("2026-04-12T15:00:00Z", datetime(2026, 4, 12, 15)),
    ("2026-04-12T15:00:00", datetime(2026, 4, 12, 15)),
    ("2026-04-12T23:30:00-03:00", datetime(2026, 4, 13, 2, 30)),
    ("20260412T153000+0530", datetime(2026, 4, 12, 10)),
    ("2026-04-12 15:00:00.1234567", datetime(2026, 4, 12, 15, 0, 0, 123456)),
])
def test_timestamps(spark, value, expected):
    assert one(spark, value, coerce.parse_datetime) == expected


@pytest.mark.parametrize("value, expected", [
    (None, None), ("", None), ("x", None), ("2026-04", None), ("2026-04-12T10", None), ("2026-0412", None),
    ("2026-04-12", date(2026, 4, 12)), ("20260412", date(2026, 4, 12)),
])
def test_dates(spark, value, expected):
    assert one(spark, value, coerce.parse_date) == expected


def test_timestamps_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        assert one(spark, "2026-04-12T15:00:00Z", coerce.parse_datetime) == datetime(2026, 4, 12, 15)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_response_types(spark):
    row = one(spark, '{"hard_skills": "a, A,,b", "experiencia_anos": 2.9, "salary": 5000.0, "contrato": ["PJ"],'
                     ' "confidence_score": true, "nice_to_have": [1, null]}', responses.response_features)
    assert (row.hard_skills, row.years_experience, row.salary) == (["a", "b"], 2, ["5000"])
    assert (row.contract_type, row.confidence_score, row.nice_to_have) == (["PJ"], 1.0, ["1", "None"])
    assert one(spark, "no json", responses.response_features).hard_skills == []


@pytest.mark.parametrize("value, expected", [
    ("https://Jobs.Example.com:8443/x?y#z", "jobs.example.com"), ("not a url", "Direct"), (None, "Direct"),
])
def test_hosts(spark, value, expected):
    assert one(spark, value, coerce.url_host) == expected


def test_grouped_alternatives_match_like_the_plain_list(spark):
    """Grouping by first letter is a matter of speed: the matches are those of the list in its order."""
    pick = random.Random(11)
    spelled = [re.sub(r"\\(.)", r"\1", re.sub(r"\\s[+*]", " ", a)) for a in vocab.TECHNOLOGIES + vocab.SOFT_SKILLS]
    lines = [" ".join(pick.choice(spelled + ["com", "e,", "x"]) for _ in range(12)) for _ in range(150)]
    plain = text._any_of(vocab.TECHNOLOGIES)
    pattern = f"{text._NOT_AFTER_WORD}{text._FOLD}({plain}){text._NOT_BEFORE_WORD}"
    frame = spark.createDataFrame([(line,) for line in lines], "line string")
    found = frame.select(
        F.regexp_extract_all("line", F.lit(text.TECHNOLOGY_PATTERN), F.lit(1)).alias("grouped"),
        F.regexp_extract_all("line", F.lit(pattern), F.lit(1)).alias("plain"),
    ).collect()
    assert sum(len(r.plain) for r in found) > 300
    assert all(r.grouped == r.plain for r in found)


def test_entities_like_a_sequential_decoder(spark):
    import html
    import random

    from postmill.functions import entities

    pick = random.Random(11)
    names = [name.rstrip(";") for name in html.entities.html5]
    pieces = ["&", ";", "#", "x", "a", " ", "&amp", "&lt;", "&notit;", "&#38;", "&#x1F600;", "&#0;", "&#128;", "&#xD800;", "&#1114112;",
              "&#99999999999999999999;", "&#xfdd0;", "&#65534;", "&#13;", "&#11;", "&#;", "&#x;", "&#x41", "&nope;", "é", "&#\u0663;", "\n", "&#00000000065;", "&#xg;"]
    texts = ["".join(pick.choice(pieces) if pick.random() < 0.7 else "&" + pick.choice(names) + pick.choice([";", "", " "]) for _ in range(pick.randint(0, 9))) for _ in range(1500)]
    texts += [f"a&{name};b" for name in names] + [f"&#{n};" for n in [*range(1, 0x2FF), 0xD7FF, 0xE000, 0xFDEF, 0xFDF0, 0x1FFFF, 0x10FFFD, 0x10FFFF]]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = frame.select("text", entities.unescape(F.col("text")).alias("plain")).collect()
    assert [(r.text, r.plain) for r in got if r.plain != html.unescape(r.text)] == []
    assert frame.limit(1).select(entities.unescape(F.lit(None).cast("string"))).first()[0] is None


def test_frequent_entities_end_what_stands_before_them(spark):
    import html

    from postmill.functions import entities

    around = ["&lt{};", "&am{}p;", "&amp;{}", "&#65{}", "&#x41{};", "&x{} a;", "&&{};", "&notit{};;", "&#38;{}", "& {}&gt", "{}"]
    texts = [a.format(f"&{name};") for name in ("nbsp", "eacute", "Ccedil", "bull") for a in around] + ["&amp;nbsp;", "&#38;nbsp;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", entities.unescape(F.col("t")).alias("got")).collect()
    assert [r.got for r in rows] == [html.unescape(r.t) for r in rows]


def test_labels_are_found_by_first_letter(spark):
    from postmill.functions import vocab

    names = [*vocab.ALIASES, *vocab.LABELS, "", " R ", "é", "Zig", "~", "\u212aafka"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.label(F.col("n")).alias("got")).collect()
    def expected(n):
        key = n.strip().lower()
        return vocab.LABELS.get(vocab.ALIASES.get(key, key)) or (n.upper() if len(n) <= 2 else n.strip())
    assert [r.got for r in rows] == [expected(r.n) for r in rows]
