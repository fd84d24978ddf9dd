import threading
import time

import pytest
from pyspark.sql import functions as F

from litgrid.operators import budget, paging, related, resolve
from litgrid.operators import search as S
from litgrid.streaming import flow


@pytest.fixture(scope="module")
def records(spark):
    rows = [(1, "Heart study", ["Ann Lee"], "J", ["Humans", "Heart"], "eng"), (2, "Lung study", ["Bo Li"], "K", ["Humans"], "fre"), (3, "Heart notes", ["Ann Lee", "Bo Li"], "K", ["Animals", "Heart"], "eng")]
    return spark.createDataFrame(rows, "id int, title string, authors array<string>, journal string, terms array<string>, language string")


@pytest.mark.parametrize(
    ("query", "want"),
    [("heart", [1, 3]), ("heart AND notes", [3]), ('("Heart"[mesh] AND x[journal]) OR fre[language]', [2]), ("li[author] AND (k[journal] OR j[journal])", [2, 3]), ("", [1, 2, 3])],
)
def test_query_text(records, query, want):
    assert sorted(r["id"] for r in S.search(records, S.Search(query=query), S.Fields()).collect()) == want


@pytest.mark.parametrize("query", ["(heart", "heart)", "x[colour]", "heart AND"])
def test_bad_queries_are_refused(records, query):
    with pytest.raises(ValueError):
        S.search(records, S.Search(query=query), S.Fields())


def test_one_sided_dates_make_no_clause():
    assert S.date_range(None, "2020", None) is None


def test_exactly_one():
    assert S.exactly_one(pmids=["1"], dois=None) == "pmids"
    with pytest.raises(ValueError):
        S.exactly_one(pmids=["1"], dois=["2"])


def test_free_full_text_is_a_semi_join(spark, records):
    free = spark.createDataFrame([(1,), (1,)], "id int")
    assert [r["id"] for r in S.search(records, S.Search(free_full_text=True), S.Fields(), free).collect()] == [1]


def test_suggestions_keep_unknown_words(spark):
    got = S.suggestions(spark.createDataFrame([("hart",), ("zzzzzz",)], "word string"), spark.createDataFrame([("heart",), ("hard",)], "entry string"), 1)
    assert {r["word"]: r["corrected"] for r in got.collect()} == {"hart": "hard", "zzzzzz": "zzzzzz"}


def pages(n, pin, size):
    """Pages of n ranked rows, read one after the other in a plain loop."""
    out, offset = [], 0
    while offset < n:
        lead = [pin] if offset == 0 and pin is not None else []
        shown, used = [], 0
        for r in range(offset, min(n, offset + size)):
            if r != pin:
                if len(lead) + len(shown) == size:
                    break
                shown.append(r)
            used += 1
        out.append((lead + shown, offset + used))
        if not used:
            break
        offset += used
    return out


@pytest.mark.parametrize(("pin", "size"), [(None, 4), (1, 4), (9, 4), (0, 1), (3, 3)])
def test_pinned_pages(spark, pin, size):
    rows, offset = spark.range(11).select(F.col("id").alias("k")), 0
    for want, next_offset in pages(11, pin, size)[:4]:
        got = paging.pinned_page(rows, ["k"], F.col("k") == (-1 if pin is None else pin), offset, size).orderBy("pos").collect()
        assert [r["k"] for r in got] == want
        if got:
            assert got[0]["next_offset"] == next_offset
        offset = next_offset


def shares(sizes, total):
    """Equal shares of what is left, until nothing or everything is given."""
    kept = [0] * len(sizes)
    while True:
        hungry = [i for i, s in enumerate(sizes) if kept[i] < s]
        left = total - sum(kept)
        if not hungry or left <= 0:
            return kept
        share = left // len(hungry)
        if not share:
            for i in hungry[:left]:
                kept[i] += 1
            return kept
        for i in hungry:
            kept[i] = min(sizes[i], kept[i] + share)


@pytest.mark.parametrize("total", [0, 1, 7, 20, 33, 1000])
def test_budgets(spark, total):
    sizes = [5, 0, 17, 3, 3, 40, 1]
    rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(sizes)], "a int, o int, s int")
    assert [r["kept"] for r in budget.outline(rows, "a", "o", "s", total).orderBy("o").collect()] == shares(sizes, total)
    left, want = total, []
    for s in sizes:
        want.append(min(s, 10, left))
        left -= want[-1]
    assert [r["kept"] for r in budget.truncate(rows, "a", "o", "s", total, 10).orderBy("o").collect()] == want


def test_reconcile_takes_the_last_reply(spark):
    asked = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    replies = spark.createDataFrame([("a", "ambiguous", 1), ("a", "matched", 2)], "key string, status string, n int")
    assert sorted((r["key"], r["status"]) for r in resolve.reconcile(asked, replies, "key", "n").collect()) == [("a", "matched"), ("a", "matched"), ("b", "not_found")]


def test_match_reply(spark):
    lines = ["J|2000|1|2|A|k1|123", "J|||||k2|AMBIGUOUS 5,6", "J|||||k3|NOT_FOUND;x", "short"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select(F.inline(F.array(resolve.parse_match_reply(F.col("line"))))).collect()
    assert [(r["key"], r["status"], r["matched_id"], r["candidates"]) for r in got] == [("k1", "matched", "123", None), ("k2", "ambiguous", None, ["5", "6"]), ("k3", "not_found", None, None), (None, "not_found", None, None)]


def test_first_provider(spark):
    a = spark.createDataFrame([(1, 10)], "src int, dst int")
    b = spark.createDataFrame([(1, 11), (2, 20)], "src int, dst int")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "src int")
    got = related.first_provider(asked, "src", [("a", a, True), ("b", b, True)]).collect()
    assert sorted((r["src"], r["dst"], r["provider"]) for r in got) == [(1, 10, "a"), (2, 20, "b")]


def test_links_drop_self_and_repeats(spark):
    edges = spark.createDataFrame([(1, 1, 0), (1, 3, 1), (1, 2, 2), (1, 3, 3), (1, None, 4)], "s int, d int, n int")
    assert [(r["dst"], r["pos"]) for r in related.linked(edges, "s", "d", ["n"]).orderBy("pos").collect()] == [(3, 1), (2, 2)]


def test_admission_schedule_equals_a_loop(spark):
    arrivals, gap = [0, 1, 2, 50, 51, 51, 400], 20
    rows = spark.createDataFrame([(1, i, a) for i, a in enumerate(arrivals)], "q int, i int, a long")
    want, last = [], -gap
    for a in arrivals:
        last = max(a, last + gap)
        want.append(last)
    assert [r["start_ms"] for r in flow.admission(rows, "q", "i", "a", gap).orderBy("i").collect()] == want


def test_retries():
    calls = []

    def f():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert flow.Retry(base_s=0.001).call(f, lambda e: isinstance(e, ConnectionError)) == "ok" and len(calls) == 3
    with pytest.raises(KeyError):
        flow.Retry(base_s=0.001).call(lambda: {}["x"], lambda e: False)
    with pytest.raises(TimeoutError):
        flow.Retry(base_s=5, deadline_s=0.1).call(lambda: 1 / 0, lambda e: True)


def test_cancelled_wait_ends_at_once():
    stop = threading.Event()
    threading.Timer(0.05, stop.set).start()
    began = time.monotonic()
    with pytest.raises(InterruptedError):
        flow.Retry(base_s=2).call(lambda: 1 / 0, lambda e: True, stop)
    assert time.monotonic() - began < 1


def test_admission_gap_and_overflow():
    a = flow.Admission(0.02, 2, waiting=0)
    with pytest.raises(RuntimeError), a:
        pass
    a, starts = flow.Admission(0.02, 2), []

    def go():
        with a:
            starts.append(time.monotonic())

    threads = [threading.Thread(target=go) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    starts.sort()
    assert min(b - a for a, b in zip(starts, starts[1:], strict=False)) >= 0.019


def test_settings_are_typed_and_ranged():
    from litgrid.operators.catalog import Settings

    assert Settings.read({}).max_retries == 6 and Settings.read({"litgrid.timeout_ms": " "}).timeout_ms == 30_000
    for name, bad in (("max_concurrent", "17"), ("timeout_ms", "999"), ("request_delay_ms", "x"), ("corpus_enabled", "maybe"), ("access_email", "no address")):
        with pytest.raises(ValueError):
            Settings.read({f"litgrid.{name}": bad})
    assert Settings.read({"litgrid.api_key": "k", "litgrid.request_delay_ms": "334"}).request_delay_ms == 334


def test_search_pages_have_limits(spark):
    from litgrid.operators import search as S

    rows = spark.createDataFrame([(1, "a")], "id int, title string")
    for bad in ({"offset": 9999}, {"offset": -1}, {"sort": "size"}):
        with pytest.raises(ValueError):
            S.results(rows, S.Search(**bad), S.Fields())
    assert S.results(rows, S.Search(offset=5), S.Fields()).collect() == []


def test_cursors_end():
    from litgrid.operators.paging import next_cursor

    page = [{"s": 3, "id": "b"}, {"s": 2, "id": "a"}]
    assert next_cursor(page, "s", "id", 2) == (2, "a") and next_cursor(page[:1], "s", "id", 2) is None and next_cursor([], "s", "id", 2) is None


def test_actions_end_in_time(spark):
    import time

    from litgrid.streaming import flow

    assert flow.with_deadline(spark, 60, lambda: spark.range(3).count(), "quick") == 3
    began = time.monotonic()
    with pytest.raises(Exception):
        flow.with_deadline(spark, 1, lambda: spark.range(4).rdd.map(lambda x: time.sleep(60)).count(), "slow")
    assert time.monotonic() - began < 30


def test_each_reply_is_parsed_once(spark, small):
    """What stands in the plans is one parse for each row, whatever number of fields is taken from it."""
    from litgrid.plans import registry

    for name, parser, most in (("summary_roundtrip", "from_xml", 1), ("record_xml_roundtrip", "from_xml", 1)):
        plan = registry.queries()[name](spark, small)._jdf.queryExecution().optimizedPlan().toString().lower()
        assert 0 < plan.count(parser) + plan.count("xmltostructs") <= most, (name, plan.count(parser), plan.count("xmltostructs"))


def test_relevance_counts_words(spark):
    from litgrid.operators import search as S

    got = spark.createDataFrame([(1, "Deep sea Sea"), (2, "sky"), (3, None)], "id int, t string").select("id", S.relevance(F.col("t"), ["SEA", "deep"]).alias("r")).collect()
    assert [(r["id"], r["r"]) for r in got] == [(1, 2), (2, 0), (3, None)]
