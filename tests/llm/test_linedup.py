import random
import re

from cases import documents, identified, prose, texts

from postmill.llm import linedup

BLANK = " \t\n\r\x0b\x0c"


def maximal(by_id, least=linedup.MIN_WORDS):
    """Texts without the lines of every common run of a place and an earlier one that holds `least` words."""
    out, seen = {}, []
    for doc, text in sorted(by_id.items()):
        if text is None:
            out[doc] = (0, 0, None)
            continue
        parts = text.split("\n")
        spoken = [i for i, p in enumerate(parts) if p.strip(BLANK)]
        said = [parts[i] for i in spoken]
        counts = [len(re.findall(r"[^\x20\x09-\x0D]+", p)) for p in said]
        seen.append(said)
        gone = set()
        for k in range(len(said)):
            for there in seen:
                for q in range(k if there is said else len(there)):
                    both = zip(said[k:], there[q:])
                    n = next((m for m, (a, b) in enumerate(both) if a != b), min(len(said) - k, len(there) - q))
                    gone |= set(spoken[k : k + n]) if sum(counts[k : k + n]) >= least else set()
        out[doc] = (len(spoken), len(gone), "\n".join(p for i, p in enumerate(parts) if i not in gone))
    return out


def result(frame):
    return {r.doc_id: (r.n_lines, r.n_removed_lines, r.text) for r in frame.collect() if r.doc_id is not None}


def test_matches_brute_force(spark):
    docs = documents(spark)
    out = linedup.without_repeats(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed_lines"]
    assert out.count() == len(texts())
    assert result(out) == maximal(identified())


def test_runs_of_short_lines_need_doubling(spark):
    """Lines of one to three words, so that runs of up to ten lines decide."""
    pieces = [prose(s, 1 + s % 3) for s in range(12)]
    rows = [
        (0, "\n".join(pieces), "en", "a"), (1, "\n".join(pieces[2:9]), "en", "a"), (2, "\n".join(pieces[:4] + ["else"] + pieces[4:]), "en", "a"),
        (3, "\n".join(pieces[5:] + pieces[5:]), "en", "a"), (4, "\n\n".join(pieces[1:8]), "en", "a"), (5, "\n".join(pieces[:3]), "en", "a"),
    ]
    want = maximal({d: t for d, t, *_ in rows})
    assert result(linedup.without_repeats(documents(spark, rows))) == want
    assert sum(v[1] for v in want.values()) > 10


def test_rows_without_id_or_text_are_left(spark):
    rows = [(None, prose(1, 40), "en", "a"), (1, prose(1, 40), "en", "a"), (2, None, "en", "a")]
    got = {(r.doc_id, r.text) for r in linedup.without_repeats(documents(spark, rows)).collect()}
    assert got == {(d, t) for d, t, *_ in rows}


def test_empty_table(spark):
    assert linedup.line_dedup(documents(spark, [])).collect() == []


def test_short_last_lines_of_repeated_runs_go(spark):
    """A copy of a long line and a short one goes whole, also if copies differ in how far they agree."""
    long, tail = prose(1, 12).replace("\n", " "), ["Bye now", "so long", "and thanks"]
    rows = [
        (0, "\n".join([long, *tail])), (1, "\n".join([long, *tail])), (2, "\n".join([long, tail[0], "else"])),
        (3, "\n".join([long, tail[1]])), (4, "\n".join([long, "", tail[1], tail[2]])), (5, "\n".join([*tail, long, tail[0]] * 2)),
        (6, "\n".join([*tail, *tail])), (7, "\n".join([*tail, *tail, "else"])),
    ]
    got = result(linedup.without_repeats(documents(spark, [(*r, "en", "a") for r in rows])))
    assert got == maximal(dict(rows))
    assert got[1] == (4, 4, "") and got[2][2] == "else"


def test_matches_brute_force_of_maximal_runs(spark):
    pick = random.Random(5)
    pool = [" ".join(prose(s, s % 13 + 1).split()) for s in range(8)]
    rows = [(i, "\n".join(pick.choice(pool) for _ in range(pick.randint(0, 14)))) for i in range(60)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(rows[:20])]
    want = maximal(dict(rows))
    assert result(linedup.without_repeats(documents(spark, [(*r, "en", "a") for r in rows]))) == want
    assert sum(v[1] for v in want.values()) > 100


def test_common_runs_are_compared_by_parts(spark, monkeypatch):
    """Lines, lone and within runs, that stand in far more places than are compared at once."""
    monkeypatch.setattr(linedup, "COMMON", 5)
    hot, short = prose(1, 12).replace("\n", " "), [prose(s, 4).replace("\n", " ") for s in range(20, 23)]
    rows = [(i, "\n".join([prose(100 + i, 11), hot, *short, prose(200 + i, 3), *short[: i % 4]])) for i in range(90)]
    rows += [(300, hot), (301, "\n".join([hot, hot])), (302, "\n".join(short)), (303, "\n".join(short * 2))]
    want = maximal(dict(rows))
    assert result(linedup.without_repeats(documents(spark, [(*r, "en", "a") for r in rows]))) == want
    assert sum(v[1] for v in want.values()) > 300
