"""Set-based operators against row-by-row references on small random inputs."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from postmill import schema
from postmill.operators import analytics, dimensions, ingest, labels, listing, split
from postmill.plans.extraction import extract_and_load
from postmill.plans.ingest import close_run, ingest_pages
from postmill.session import scratch_path
from postmill.sources import exports
from postmill.sources.tables import Store, empty_table, jdbc_table
from postmill.streaming import jobs as streams

T0 = datetime(2024, 1, 1)


def test_cut_and_first_per_id_like_a_sequential_run(spark):
    rng = random.Random(7)
    terms = [(i, f"t{i}", T0 + timedelta(days=rng.randint(0, 9)) if i % 3 else None) for i in range(1, 7)]
    rows = [
        (f"t{rng.randint(1, 6)}", page, pos, rng.randint(1, 60),
         None if rng.random() < 0.1 else T0 + timedelta(days=rng.randint(0, 20)))
        for page in range(1, 9) for pos in range(12)
    ]
    stored = {3, 14, 15}

    expected, seen, reached = set(), set(stored), {}
    for _, term, mark in sorted(terms, reverse=True):
        reached[term] = False
        for row in sorted((r for r in rows if r[0] == term), key=lambda r: r[1:3]):
            if mark and row[4] and row[4] <= mark:
                reached[term] = True
                break
            if row[3] not in seen:
                seen.add(row[3])
                expected.add(row[:4])

    frame = spark.createDataFrame(rows, "term string, page int, position int, id bigint, published_date timestamp_ntz")
    marks = spark.createDataFrame(terms, "id bigint, term string, last_scraped_at timestamp_ntz")
    kept = ingest.without_stored(
        ingest.first_per_id(ingest.newer_prefix(frame, marks), marks),
        spark.createDataFrame([(i,) for i in stored], "id bigint"),
    )
    assert {(r.term, r.page, r.position, r.id) for r in kept.collect()} == expected
    outcomes = ingest.term_outcomes(marks, kept, ingest.first_old_positions(frame, marks)).collect()
    assert {r.term: r.reached_old for r in outcomes} == reached
    assert sum(r.inserted for r in outcomes) == len(expected)


def test_companies_like_a_sequential_run(spark):
    rng = random.Random(3)
    posts = [(i, rng.randint(1, 25), rng.choice(["Acme", "Beta", "", None, "Gama"])) for i in range(1, 120)]
    taken = {900: "Beta"}

    companies = dict(taken)
    for post, company, posted in sorted(posts):
        if company in companies:
            continue
        name = posted or f"Empresa {company}"
        companies[company] = f"{name} ({company})" if name in companies.values() else name
    expected = {k: v for k, v in companies.items() if k not in taken}

    stored = spark.createDataFrame(list(taken.items()), schema.DIMENSION)
    frame = spark.createDataFrame(posts, "id bigint, company_id bigint, career_page_name string")
    got = dimensions.new_companies(stored, frame)
    assert {r.id: r.name for r in got.collect()} == expected


def test_company_without_id_and_name_clash(spark):
    posts = spark.createDataFrame(
        [(1, None, "Solo"), (2, None, "Solo"), (3, 7, "Acme"), (4, 8, "Acme"), (5, 9, "Acme (8)")],
        "id bigint, company_id bigint, career_page_name string",
    )
    new = dimensions.new_companies(empty_table(spark, "companies"), posts)
    assert sorted(r.name for r in new.collect()) == ["Acme", "Acme (8)", "Acme (8)", "Solo"]
    assert [r.id for r in dimensions.company_name_clashes(empty_table(spark, "companies"), new).collect()] == [9]


def test_id_collisions_give_the_later_key_another_id(spark, monkeypatch):
    stored = spark.createDataFrame([(1, "a")], schema.DIMENSION)
    clash = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], schema.DIMENSION)
    got = {r.name: r.id for r in dimensions.checked_ids(stored, clash).collect()}
    assert set(got) == {"b", "c", "d"} and len({1, *got.values()}) == 4 and got["c"] == 2
    monkeypatch.setattr(dimensions, "member_id", lambda keys, attempt=0: F.lit(1).cast("bigint"))
    with pytest.raises(Exception, match="no free id for a key"):
        dimensions.checked_ids(stored, clash).collect()


def _tag_by_hand(text, spans):
    tokens = text.split()
    tags = ["O"] * len(tokens)
    for span, label in spans:
        words = span.split()
        for i in range(len(tokens) - len(words) + 1):
            if words and all(tokens[i + j].lower() == words[j].lower() for j in range(len(words))):
                for j in range(len(words)):
                    tags[i + j] = ("I-" if j else "B-") + label
    return tokens, tags


def test_bio_tags_like_a_scan(spark):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        words = [rng.choice("a A b c d".split()) for _ in range(rng.randint(1, 30))]
        hard = ",".join(" ".join(rng.choice("abcd") for _ in range(rng.randint(1, 3))) for _ in range(3))
        rows.append((str(i), "  ".join(words), hard, rng.choice([None, "nan", "a b, ,c"]), "Não informado", "d d", None))
    expected = {}
    for ident, description, hard, soft, _, level, _ in rows:
        spans = [(s.strip(), "HARD_SKILL") for s in hard.split(",")]
        if soft and soft != "nan":
            spans += [(s.strip(), "SOFT_SKILL") for s in soft.split(",")]
        spans.append((level, "NIVEL"))
        tokens, tags = _tag_by_hand(description, spans)
        if any(t != "O" for t in tags):
            expected[ident] = (tokens, tags)
    got = labels.training_examples(spark.createDataFrame(rows, schema.LABELLED)).collect()
    assert {r.id: (r.tokens, r.ner_tags) for r in got} == expected


def test_entity_spans(spark):
    tags = ["I-A", "I-A", "B-A", "I-B", "O", "I-B", "B-B"]
    row = spark.createDataFrame([(tags,)], "t array<string>").select(labels.entity_spans(F.col("t")).alias("s")).first()
    assert [tuple(s) for s in row.s] == [("A", 0, 1), ("A", 2, 2), ("B", 3, 3), ("B", 5, 5), ("B", 6, 6)]


def test_scores_without_entities(spark):
    frame = spark.createDataFrame([(["O"], ["O"])], "gold array<string>, predicted array<string>")
    assert labels.entity_scores(frame).first().asDict()["f1"] == 0.0


@pytest.mark.parametrize("n, share", [(1735, 0.9), (10, 0.05), (1, 0.9), (7, 1.0)])
def test_ordered_split(spark, n, share):
    rows = spark.range(n).select((F.col("id") * 7919 % 100003).alias("k"))
    parts = split.ordered_split(rows, "k", share).collect()
    train = sorted(r.k for r in parts if r.part == "train")
    assert train == sorted(r.k for r in parts)[: int(n * share)]


def test_undated_posts_count_as_a_day(spark):
    posts = spark.createDataFrame([(T0,), (None,), (T0,)], "published_date timestamp_ntz")
    assert analytics.average_posts_per_day(posts).first().average == 1.5


def test_paging(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else f"n{i % 3}") for i in range(1, 24)], "id bigint, name string")
    for order in ("asc", "desc"):
        by = listing.post_ordering("name", order)
        pages = [[r.id for r in listing.page_of(rows, by, p, 5).collect()] for p in range(1, 7)]
        assert pages[-1] == [] and len(sum(pages, [])) == 23
        last = rows.where(F.col("id") == pages[1][-1]).first()
        after = listing.page_after(rows, "name", last.name, last.id, order, 5)
        assert [r.id for r in after.collect()] == pages[2]
    info = listing.page_info(rows, 6, 5).first()
    assert (info.total_pages, info.has_next, info.has_prev) == (5, False, True)
    assert listing.page_info(rows.where("false")).first().total_pages == 1
    assert listing.page_arguments(500, 500) == (500, 100)


def test_lookup_of_a_missing_row_fails(spark):
    rows = spark.createDataFrame([(1, "a")], "id bigint, name string")
    with pytest.raises(Exception, match="row with id 2 not found"):
        listing.lookup(rows, 2).collect()


def test_term_filters(spark):
    terms = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id bigint, term string, is_active boolean")

    def ids(**options):
        return sorted(r.id for r in listing.filter_terms(terms, **options).collect())

    assert ids() == [1] and ids(include_inactive=True) == [1, 2]
    assert ids(status="inactive") == [2] and ids(status="active", include_inactive=True) == [1]


def _page(term, page, rows):
    return json.dumps({"term": term, "page": page, "data": rows, "pagination": {"total": len(rows)}}, ensure_ascii=False)


def _row(ident, day, **extra):
    base = {
        "id": ident, "companyId": 1, "name": f"Vaga {ident}", "description": "Python e Django", "careerPageId": 1,
        "careerPageName": "Acme", "careerPageLogo": None, "careerPageUrl": "u", "publishedDate": f"2024-01-{day:02d}T00:00:00Z",
        "city": "Recife", "state": "PE", "skills": {"k": "ção"},
    }
    return base | extra


def _land(spark, lines):
    path = scratch_path(spark, "landing")
    spark.createDataFrame([(line,) for line in lines], "value string").write.text(path)
    return path


def test_ingest_then_extract_then_repeat(spark):
    store = Store(spark, scratch_path(spark, "store"))
    terms = [(1, "dev", True, datetime(2024, 1, 5)), (2, "data", True, None), (3, "off", False, None), (4, "bad", True, None)]
    store.replace("search_terms", spark.createDataFrame(terms, schema.SEARCH_TERM))
    damaged = _row(30, 9)
    del damaged["companyId"]
    landing = _land(spark, [
        _page("dev", 1, [_row(1, 9), _row(2, 8), damaged, _row(31, 9, name="x" * 256)]),
        _page("dev", 2, [_row(3, 5), _row(4, 9)]),
        _page("data", 1, [_row(2, 8), _row(5, 1), _row(6, 1, publishedDate="?", state=None)]),
        '{"term": "bad", "page": 1, "data": ',
        '{"term": "bad", "page": 1}',
    ])
    run_at = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    streams.ingest_stream(store, landing, scratch_path(spark, "checkpoint"), "one").awaitTermination()
    assert store.read("jobs_posts").count() == 0
    close_run(store, "one")
    close_run(store, "one")
    posts = store.read("jobs_posts")
    assert sorted(r.id for r in posts.collect()) == [1, 2, 5, 6, 31]
    assert {r.skills for r in posts.collect()} == {'{"k":"ção"}'}
    assert store.read("error_logs").count() == 3
    assert store.read("error_logs").select("id").distinct().count() == 3
    marks = {r.term: r.last_scraped_at for r in store.read("search_terms").collect()}
    assert marks["off"] is None and marks["bad"] is None and marks["dev"] > datetime(2024, 1, 5)

    ingest_pages(store, spark.read.schema(_schema()).json(landing), run_at, full=True)
    assert sorted(r.id for r in store.read("jobs_posts").collect()) == [1, 2, 3, 4, 5, 6, 31]

    extract_and_load(store, limit=2)
    assert sorted(r.id for r in store.read("jobs").collect()) == [1, 2]
    streams.extraction_stream(store, scratch_path(spark, "checkpoint")).awaitTermination()
    jobs = store.read("jobs")
    assert sorted(r.id for r in jobs.collect()) == [1, 2, 3, 4, 5, 6, 31]
    assert {r.id for r in jobs.where("city_id is null").collect()} == {6}
    assert [r.name for r in store.read("hard_skills").orderBy("name").collect()] == ["Django", "Python"]
    assert store.read("job_hard_skills").count() == 14
    assert [r.name for r in store.read("companies").collect()] == ["Acme"]


def _schema():
    from postmill.sources import pages

    return pages.RAW_PAGE


@pytest.mark.parametrize(("landed", "finished"), [
    ([("a", 1, "usable"), ("a", 2, "wrong")], []),
    ([("a", 1, "usable"), ("a", 2, "lost")], ["a"]),
    ([("a", 1, "usable"), ("a", 3, "wrong")], ["a"]),
    ([("a", 2, "usable"), ("a", 3, "usable")], []),
    ([("a", 1, "lost"), ("a", 2, "usable")], []),
    ([("a", 1, "wrong"), ("a", 1, "usable")], ["a"]),
    ([("a", 1, "usable"), ("a", 2, "usable"), ("b", 1, "usable"), ("b", 2, "usable"), ("b", 3, "wrong")], ["a"]),
    ([("c", 1, "usable"), ("c", 2, "wrong")], ["c"]),  # a known post on page 1: page 2 is not asked for
    ([("d", 1, "wrong"), ("d", 2, "usable")], []),  # the known post stands behind the failure
    ([(None, None, "lost")], []),
])
def test_terms_finish_by_their_first_gap(spark, landed, finished):
    pages = spark.createDataFrame(landed, "term string, page int, state string")
    cuts = spark.createDataFrame([("c", (1, 3)), ("d", (2, 0))], "term string, cut struct<page: int, position: int>")
    assert sorted(r.term for r in ingest.finished_terms(pages, cuts).collect()) == finished


def test_cut_pages_are_named_by_text_or_path(spark):
    from postmill.sources import pages

    root = scratch_path(spark, "landing")
    spark.createDataFrame([('{"term": "dev", "page": 2, "data": [{"id": ',), ('{"te',)], "value string").coalesce(1).write.text(f"{root}/term=data lead/page=7.json")
    found = {(r.term, r.page, r.state) for r in pages.page_states(pages.read_pages(spark, f"{root}/*/*")).collect()}
    assert found == {("dev", 2, "lost"), ("data lead", 7, "lost")}


def test_settled_terms_are_stored_while_a_run_is_open(spark):
    """The newest terms' posts are stored as soon as known ones are reached without a gap; closing gives the same as one batch."""
    from postmill.plans.ingest import add_pages, settle_run
    from postmill.sources import pages

    def read(lines):
        return pages.read_pages(spark, _land(spark, lines))

    terms = [(1, "old", True, datetime(2024, 1, 5)), (2, "mid", True, datetime(2024, 1, 5)), (3, "new", True, datetime(2024, 1, 5))]
    first = [_page("new", 2, [_row(11, 8), _row(12, 4)]), _page("mid", 1, [_row(21, 9), _row(22, 3)]), _page("old", 1, [_row(21, 9), _row(31, 1)])]
    second, third = [_page("new", 1, [_row(10, 9)])], [_page("old", 2, [_row(32, 1)])]
    stores = [Store(spark, scratch_path(spark, "store")) for _ in range(2)]
    for store in stores:
        store.replace("search_terms", spark.createDataFrame(terms, schema.SEARCH_TERM))
    store, plain = stores

    def stored(store):
        return sorted(r.id for r in store.read("jobs_posts").collect())

    add_pages(store, "r", read(first), "a-0")
    settle_run(store, "r")
    assert stored(store) == []  # page 1 of the newest term is not there
    add_pages(store, "r", read(second), "a-1")
    settle_run(store, "r")
    settle_run(store, "r")
    assert stored(store) == [10, 11, 21]
    add_pages(store, "r", read(third), "b-0")
    close_run(store, "r")
    ingest_pages(plain, read(first + second + third))
    assert stored(store) == stored(plain) == [10, 11, 21]
    assert {r.term for r in store.read("search_terms").where("last_scraped_at > timestamp_ntz '2024-02-01'").collect()} == {"old", "mid", "new"}


def test_csv_bytes(spark):
    posts = empty_table(spark, "jobs_posts").unionByName(
        spark.createDataFrame(
            [(1, "a, \"b\"\nc", datetime(2024, 1, 2), True), (2, " x ", None, None)],
            "id bigint, name string, published_date timestamp_ntz, is_remote_work boolean",
        ),
        allowMissingColumns=True,
    )
    path = scratch_path(spark, "csv")
    exports.write_csv(exports.post_csv_rows(posts).coalesce(1), path)
    text = spark.read.text(path, wholetext=True).first().value
    assert text == (
        ",".join(exports.POST_CSV_COLUMNS) + "\n"
        "2,, x ,,,,,,,,,,,,,,,\n"
        '1,,"a, ""b""\nc",,,,,2024-01-02T00:00:00,,True,,,,,,,,\n'
    )


def test_jdbc_source(spark):
    url = "jdbc:derby:memory:postmill;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    frame = spark.range(100).select("id", F.concat(F.lit("n"), "id").alias("name"))
    try:
        frame.write.jdbc(url, "companies", properties=options)
    except Exception as error:  # no embedded database on the class path
        pytest.skip(f"no JDBC driver: {str(error)[:80]}")
    read = jdbc_table(spark, url, "companies", "id", (10, 60), 4, **options)
    assert read.rdd.getNumPartitions() == 4
    assert read.count() == 100


def _fold(terms, changes):
    """Changes applied one after the other to a plain dictionary."""
    rows, failures = {t[0]: (t[1], t[2]) for t in terms}, []
    for seq, op, ident, term, active in sorted(changes):
        if op == "add":
            if ident in rows or term in {t for t, _ in rows.values()}:
                failures.append(("Search term already stored", seq))
            else:
                rows[ident] = (term, True)
        elif ident not in rows:
            failures.append(("Search term not found", seq))
        elif op == "update":
            rows[ident] = (rows[ident][0], active)
        else:
            del rows[ident]
    return {(i, t, a) for i, (t, a) in rows.items()}, set(failures)


@pytest.mark.parametrize("changes", [
    [(1, "delete", 1, None, None), (2, "update", 1, None, False)],
    [(1, "delete", 1, None, None), (2, "add", 1, "new", None), (3, "update", 1, None, False)],
    [(1, "delete", 1, None, None), (2, "delete", 1, None, None)],
    [(1, "add", 7, "x", None), (2, "add", 8, "x", None), (3, "update", 8, None, False)],
    [(1, "add", 7, "one", None), (2, "delete", 1, None, None), (3, "add", 8, "one", None), (4, "update", 8, None, False)],
    [(1, "add", 7, "x", None), (2, "delete", 7, None, None), (3, "add", 8, "x", None), (4, "add", 7, "x", None)],
    [(1, "update", 2, None, True), (2, "update", 2, None, False), (3, "add", 2, "y", None), (4, "update", 5, None, True)],
])
def test_changes_apply_one_after_the_other(spark, changes):
    stored = [(1, "one", True, None), (2, "two", True, None)]
    terms = spark.createDataFrame(stored, schema.SEARCH_TERM)
    frame = spark.createDataFrame(changes, "seq long, op string, id long, term string, is_active boolean")
    rows, failures = _fold(stored, changes)
    assert {(r.id, r.term, r.is_active) for r in dimensions.apply_changes(terms, frame).collect()} == rows
    found = dimensions.rejected_changes(terms, frame).collect()
    assert {(r.message, json.loads(r.payload)["seq"]) for r in found} == failures


def test_new_rows_with_one_key_leave_the_first(spark):
    stored = spark.createDataFrame([(1, "a", True)], "id long, term string, is_active boolean")
    new = spark.createDataFrame([(9, "b", True), (5, "b", False), (6, "a", False)], "id long, term string, is_active boolean")
    merged = dimensions.insert_if_absent(stored, new, order=("id",))
    assert {tuple(r) for r in merged.collect()} == {(1, "a", True), (5, "b", False)}


def test_a_version_without_rows_is_the_newest(spark):
    store = Store(spark, scratch_path(spark, "store"))
    terms = spark.createDataFrame([(1, "dev", True, None)], schema.SEARCH_TERM)
    store.replace("search_terms", terms)
    store.replace("search_terms", terms.where("false"))
    assert store.read("search_terms").count() == 0
    # left by an attempt that failed before it was published
    terms.write.parquet(f"{store.path('search_terms')}/version=3")
    assert store.read("search_terms").count() == 0
    store.replace("search_terms", terms.withColumn("term", F.lit("data")))
    assert [r.term for r in store.read("search_terms").collect()] == ["data"]


def _posts_to_load(spark, ids):
    rows = [(i, f"Vaga {i}", "<p>Python e Django, proatividade, R$ 5.000 CLT</p>", i % 3, f"Empresa {i % 3}", "PE", "Recife") for i in ids]
    given = "id bigint, name string, description string, company_id bigint, career_page_name string, state string, city string"
    return empty_table(spark, "jobs_posts").unionByName(spark.createDataFrame(rows, given), allowMissingColumns=True)


def _counts(store):
    return {name: store.read(name).count() for name in schema.STAR}


@pytest.mark.parametrize("writes", [0, 3, len(schema.STAR)])
def test_a_killed_load_is_not_seen(spark, monkeypatch, writes):
    """A run that dies after some or all of its writes shows the old star; the next one loads everything once."""
    store = Store(spark, scratch_path(spark, "store"))
    store.append("jobs_posts", _posts_to_load(spark, range(4)))
    extract_and_load(store)
    before = _counts(store)
    assert before["jobs"] == 4 and before["job_hard_skills"] > 0
    store.append("jobs_posts", _posts_to_load(spark, range(4, 9)))
    done, append, publish = [], Store.append, Store.publish

    def dying(self, name, rows, load=None):
        if name in schema.STAR and len(done) >= writes:
            raise RuntimeError("killed")
        done.append(name)
        append(self, name, rows, load)

    def unpublished(self, load, replaces=()):
        raise RuntimeError("killed")

    monkeypatch.setattr(Store, "append", dying)
    monkeypatch.setattr(Store, "publish", unpublished)
    with pytest.raises(RuntimeError, match="killed"):
        extract_and_load(store)
    assert _counts(store) == before
    monkeypatch.setattr(Store, "append", append)
    monkeypatch.setattr(Store, "publish", publish)
    extract_and_load(store)
    after = _counts(store)
    assert after["jobs"] == 9 and after["job_hard_skills"] == before["job_hard_skills"] // 4 * 9
    assert {n: after[n] for n in ("states", "cities", "hard_skills", "soft_skills")} == {n: before[n] for n in ("states", "cities", "hard_skills", "soft_skills")}
    extract_and_load(store)
    assert _counts(store) == after


def test_merged_loads_hold_the_same_rows(spark):
    store = Store(spark, scratch_path(spark, "store"))
    for ids in (range(3), range(3, 5)):
        store.append("jobs_posts", _posts_to_load(spark, ids))
        extract_and_load(store)
    before = {name: sorted(map(str, store.read(name).collect())) for name in schema.STAR}
    lost = store.new_load()
    store.append("states", spark.createDataFrame([(1, "never published")], "id bigint, name string"), lost)
    merged = store.merge_loads()
    assert store.loads() == [merged] and store.merge_loads() is None
    store.vacuum()
    assert {name: sorted(map(str, store.read(name).collect())) for name in schema.STAR} == before
    assert "never published" not in {r.name for r in spark.read.parquet(store.path("states")).collect()}


def test_members_with_one_hash_get_ids_of_their_own(spark, monkeypatch):
    """Hashes of three values only: clashes among new members and with stored ones are resolved, and ids stay."""
    plain = dimensions.member_id
    monkeypatch.setattr(dimensions, "member_id", lambda keys, attempt=0: plain(keys, attempt) if attempt else F.pmod(F.xxhash64(*keys), F.lit(3)))
    names = spark.createDataFrame([(f"name {i}",) for i in range(20)], "name string")
    empty = spark.createDataFrame([], "id bigint, name string")
    first = dimensions.get_or_create(empty, names.where("name < 'name 15'")).collect()
    first = spark.createDataFrame(first, "id bigint, name string")
    both = dimensions.get_or_create(first, names).collect()
    assert len({r.id for r in both}) == len({r.name for r in both}) == len(both) == 20
    assert {tuple(r) for r in first.collect()} <= {tuple(r) for r in both}


def test_a_thousand_batches_leave_few_folders(spark, monkeypatch):
    """Counts stay right through merges, with a batch repeated before and after one."""
    monkeypatch.setattr(streams, "MERGE_EVERY", 3)
    counts = scratch_path(spark, "daily")
    day = datetime(2024, 1, 1)
    for batch in range(20):
        rows = spark.createDataFrame([(day + timedelta(days=batch % 4), "Python"), (day, f"T{batch % 2}"), (None, "X")], "published_date timestamp_ntz, technology string")
        for _ in range(2 if batch in (4, 7) else 1):
            streams.add_daily_counts(rows, counts, batch)
        if batch == 15:
            streams.add_daily_counts(spark.createDataFrame([(day, "T0")], "published_date timestamp_ntz, technology string"), counts, 2)
    got = {(r.period.day, r.technology): r["count"] for r in streams.live_daily_counts(spark, counts).collect()}
    assert got == {(d + 1, "Python"): 5 for d in range(4)} | {(1, "T0"): 10, (1, "T1"): 10}
    assert len(streams._ids(spark, f"{counts}/batches", "batch")) <= 6 and len(streams._ids(spark, f"{counts}/merged", "until")) <= 2


def test_scores_of_odd_tags(spark):
    """Entities are counted in batches of arrays, and as one at a time: lost tags, lost rows, other labels, unequal lengths."""
    rng = random.Random(5)

    def walked(tags):
        found, start = [], None
        for i, tag in enumerate(tags or []):
            before = "O" if i == 0 or tags[i - 1] is None else tags[i - 1]
            opens = tag not in (None, "O") and (tag.startswith("B-") or before == "O" or before[2:] != tag[2:])
            if start is not None and (opens or tag == "O"):
                found.append((start, i, tags[start][2:]))
                start = None
            start = i if opens else start
        return {*found, (start, len(tags), tags[start][2:])} if start is not None else {*found}

    def some(n):
        return None if rng.random() < 0.1 else [rng.choice(["O", "O", "B-A", "I-A", "B-É", "I-É", "B-AB", "A", "", None]) for _ in range(n)]

    rows = []
    for i in range(400):
        gold = some(rng.randrange(12))
        own = gold and [t if rng.random() < 0.7 else rng.choice(["O", "I-A"]) for t in gold]
        rows.append((i, gold, own if rng.random() < 0.8 else some(rng.randrange(12))))
    frame = spark.createDataFrame(rows, "id int, gold array<string>, predicted array<string>").repartition(3)
    scores = labels.entity_scores(frame)
    assert "MapInArrow" in scores._jdf.queryExecution().executedPlan().toString()
    got = scores.first()
    pairs = [(walked(g), walked(p)) for _, g, p in rows]
    assert (got.gold, got.predicted, got.correct) == (
        sum(len(g) for g, _ in pairs), sum(len(p) for _, p in pairs), sum(len(g & p) for g, p in pairs)
    )
    listed = frame.select("id", F.explode(labels.entity_spans(F.col("gold"))).alias("s")).collect()
    assert {(r.id, r.s.start, r.s.end + 1, r.s.label) for r in listed} == {(i, *e) for (i, *_), (g, _) in zip(rows, pairs, strict=True) for e in g}
