import re
from itertools import combinations

from polyquilt.llm import lines

WORD, SHINGLE = re.compile(lines.WORD), re.compile(lines.PATTERN)


def brute(rows):
    """The texts after dedup of rows (id, text), ids distinct."""
    first = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None and t is not None):
        for p, line in enumerate(t.split("\n")):
            if WORD.search(line):
                first.setdefault(line, (i, p))
    sets = {place: frozenset(SHINGLE.findall(line.lower())) for line, place in first.items()}
    root = {p: p for p in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: t if i is None or t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if not WORD.search(x) or find(first[x]) == (i, p)) for i, t in rows}


def check(spark, rows):
    got = lines.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute(rows)


def test_fuzzy_lines(spark, prose):
    base = prose(40, 1)
    rows = [(1, base + "\n\nshort\n" + prose(30, 2)), (2, prose(20, 3) + "\nshort\n" + base.replace(base.split()[20], "swapped", 1)), (3, base.upper() + "\n \nshort "), (4, None), (5, ""), (6, "\n\n"), (7, base + " tail"), (8, prose(40, 4))]
    words = prose(60, 5).split()
    for k in range(12):  # a drifting line, in one document
        words[5 * k] = f"drift{k}"
        rows.append((20 + k, " ".join(words) + "\n" + prose(15, 60 + k)))
    check(spark, rows)


def test_hard_rows(spark, hard_docs, no_docs):
    out = lines.dedup(hard_docs)
    assert out.columns == hard_docs.columns and out.count() == hard_docs.count()
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[2] == "" and texts[5] is None and texts[6] == "" and texts[7] == " \n\t " and texts[13].count("a line") == 1 and texts[11] == ""
    assert lines.dedup(no_docs).count() == 0


def test_no_python_in_the_plan(hard_docs):
    plan = lines.removals(hard_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def whole(rows):
    """brute() with a shingler of its own: every run of 12 characters, cut by slices."""
    first = {}
    for i, t in sorted(rows):
        for p, line in enumerate(t.split("\n")):
            if line.strip():
                first.setdefault(line, (i, p))
    sets = {place: {line.lower()[k : k + 12] for k in range(len(line) - 11)} for line, place in first.items()}
    group = {p: p for p in sets}
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 4 * both >= 3 * len(sets[a] | sets[b]):
            x, y = sorted((group[a], group[b]))
            group = {p: x if g == y else g for p, g in group.items()}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if not x.strip() or group[first[x]] == (i, p)) for i, t in rows}


def test_lines_count_to_their_last_character(spark, prose):
    """Lines that only share the head of a word, or differ in a short tail, are no copies."""
    urls = [f"https://www.{w}.org/{k}/{w[::-1]}.html" for k, w in enumerate("river market harbour mountain library".split())]
    ids = [f"AAAAAAAAAAAA{k:x}{(k * 7919 + 12345) ** 3:x}" for k in range(3, 8)]
    unspaced = ["東京都千代田区丸の内一丁目九番一" + x for x in ("号駅前広場から歩いて五分の静かな店です", "の建物は来年の春に取り壊される予定である", "😀😁😂🤣😃😄😅😆😉😊😋😎😍😘🥰😗😙🥲")]
    short = ["Chapter one: A", "Chapter one: Beginnings", "Chapter one: The harbour in winter"]
    base = prose(30, 11)
    rows = [(1, "\n".join(urls + ids + unspaced + short + [base, "short"])), (2, "\n".join([urls[0].upper(), ids[1], unspaced[2] + "。", base.replace(" ", "  ", 1), base[::-1], "Short", "short"]))]
    want = whole(rows)
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want
    assert got[1] == rows[0][1] and got[2] == base[::-1] + "\nShort"


def test_finer_buckets_and_what_lies_beyond(spark, prose, monkeypatch):
    """With blocks of a few members a family of lines with one head goes through both finer levels and on, and gives what brute force gives."""
    monkeypatch.setattr(lines, "BLOCK", 3)
    monkeypatch.setattr(lines, "LAST_BLOCK", 4)
    head = prose(30, 1)
    rows = []
    for k in range(14):  # pairs that are linked, far enough from other pairs
        tail = prose(14, 300 + k)
        rows += [(2 * k, f"{head} {tail}"), (2 * k + 1, f"{head} {tail} x{k}")]
    want = whole(rows)
    got = {r["doc_id"]: r["text"] for r in lines.dedup(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == want
    assert 0 < sum(t == "" for t in want.values()) < len(rows)


def test_comparisons_inside_buckets_are_dealt_by_number(spark, prose, monkeypatch):
    """Small buckets that take long are not put into one task for their few bytes, and their links are those of the full sets."""
    plans, cut = [], lines.common.cut
    monkeypatch.setattr(lines.common, "cut", lambda df, sweep=True: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, sweep))
    base = prose(30, 1)
    texts = [base, base + " x", prose(30, 2), base[:60], base + " " + base[::-1]]
    members = spark.createDataFrame([(1, k) for k in range(5)], "bucket bigint, k int").selectExpr("bucket", "cast(k as decimal(38,0)) place", "cast(k as decimal(38,0)) comp")
    lined = spark.createDataFrame(list(enumerate(texts)), "k int, line string").selectExpr("cast(k as decimal(38,0)) place", "line")
    assert {tuple(sorted(map(int, r))) for r in lines.across(members, lined).collect()} == {(0, 1)}
    assert len(plans) == 1 and "REPARTITION_BY_NUM" in plans[0]
