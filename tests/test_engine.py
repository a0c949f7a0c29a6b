import json
import math
import os
import shutil
import time

import pytest
from pyspark.sql import functions as F

from quillspark.api import Engine
from quillspark.functions import text as X
from quillspark.operators import query as Q
from quillspark.operators.audit import AuditLog
from quillspark.plans import search as SEARCH
from quillspark.plans import store as S
from quillspark.plans.search import Corpus, matches
from quillspark.plans.store import IndexBusy
from quillspark.sources.config import Config, normalize_prefix
from quillspark.sources.tree import changes
from quillspark.streaming.upserts import apply_changes, rate_limited, resolve

OVERVIEW = "\n# Platform Overview\n\nOur roadmap includes authentication, billing, and observability upgrades.\n\n## Authentication\n\nDetailed description about the auth roadmap.\n        "


@pytest.fixture
def repo(tmp_path):
    for rel, body in {"docs/overview.md": OVERVIEW, "readme.md": "\n# Internal README\n\nThis repository hosts design docs for the Control Plane roadmap.\n", "vendor/private.md": "# Vendor\nSKIPPED_VENDOR", "secret/note.md": "# Secret\nSKIPPED_SECRET", "code.rs": "roadmap", "empty.txt": "", "bad.md": None, "lines.md": "Line1\nLine2\nLine3\nLine4\nLine5\n"}.items():
        p = tmp_path / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"\xff\xfe roadmap") if body is None else p.write_text(body)
    return tmp_path


def test_summary_and_tokens():
    assert X.summary_of(OVERVIEW) == "Platform Overview — Our roadmap includes authentication, billing, and observability upgrades. Authentication Detailed description about the auth roadmap."
    assert X.summary_of("") == "" and X.summary_of(None) == ""
    assert X.plain_line("3.14 is pi")[0] == "14 is pi"
    assert X.plain_line("- [x] see [doc](u) and `c`")[0] == "see doc and c"
    assert X.summary_of("---\nopen") == "--- open"


def test_columns(spark):
    d = spark.createDataFrame([(OVERVIEW,), ("",), (None,), ("x" * 500,), ("a\n",)], "b string")
    r = d.select(X.estimate_tokens(F.col("b")).alias("n"), X.truncate_to_limit(F.col("b"), 360).alias("c"), F.size(X.lines(F.col("b"))).alias("l")).collect()
    assert [x.n for x in r] == [19, 0, None, 1, 1]
    assert len(r[3].c) == 360 and r[3].c.endswith("…") and r[1].c == "" and r[2].c is None
    assert [r[1].l, r[4].l] == [0, 1]


def test_parser_ladder():
    assert Q.understand("API_KEY", ("body",)).words == ("api", "key")
    assert Q.understand("-foo", ("body",)).words == ("foo",)
    assert Q.understand("(((") == Q.All() and Q.understand("   ") == Q.All()
    t = Q.understand("+a -b c", ("body",))
    assert len(t.must) == len(t.never) == len(t.should) == 1
    with pytest.raises(Q.QueryError):
        Q.parse("nofield:x")


def test_clauses(spark):
    rows = [(f"{i}", f"{i}", b, b.split()[0]) for i, b in enumerate(("a b c", "a b", "b c a-b", "c", "x a b y"))]
    c = Corpus.of(spark.createDataFrame(rows, "doc_id string, rel_path string, body string, summary string"))
    hits = lambda q, fields=("body",): {r.doc_id for r in matches(c, Q.understand(q, fields)).collect()}
    assert hits("a c") == set("01234") and hits("a AND c") == set("02") and hits("+c x") == set("023") and hits("b -c") == set("14")
    assert hits("+c +a-b") == set("02") and hits('"a b" AND (x OR c)') == set("024") and hits("+a +a") == set("0124")
    assert hits("+a +3", Q.FIELDS) == set() and hits("+c +3", Q.FIELDS) == {"3"} and hits("zzz AND a") == set()
    one = {r.doc_id: r.score for r in matches(c, Q.understand("a c^2", Q.FIELDS)).collect()}
    parts = [{r.doc_id: r.score for r in matches(c, Q.understand(q, Q.FIELDS)).collect()} for q in ("a", "c^2")]
    assert one.keys() == parts[0].keys() | parts[1].keys() and all(abs(one[k] - sum(p.get(k, 0) for p in parts)) < 1e-9 for k in one)


def test_config():
    c = Config.of(prefixes=["\\Secret"])
    assert normalize_prefix("/a") == "a/"
    assert [c.wanted(p) for p in ("a/B.MD", "secret/x.md", "secrets/x.md", "a/VENDOR/x.md", ".md", "x.rs", "logs/a.md", "docker/.data/a.md", "a/Temp/b.md", "env/a.md")] == [True, False, True, False, False, False, False, False, False, True]


def test_engine(spark, repo):
    e = Engine(spark, str(repo), prefixes=["secret"])
    assert e.index()["num_docs"] == 5
    assert oct((repo / ".quillspark").stat().st_mode)[-3:] == "700"
    hits = e.search("roadmap", limit=4)
    assert {h["doc_id"] for h in hits} == {"docs/overview.md", "readme.md"} and all(h["summary"] and h["snippet"] for h in hits)
    assert e.search("roadmap", limit=10, most=1).__len__() == 1
    assert e.search("roadmap", max_tokens=0) == [] and e.search("SKIPPED_VENDOR OR SKIPPED_SECRET") == []
    assert all(h["snippet"] == "" for h in e.search("roadmap", snippets=False))
    assert "<b>roadmap</b>" in e.snippet("readme.md", "roadmap")["snippet"]["html"]
    assert e.snippet("none.md") == {"doc": None, "snippet": None}
    assert e.files(offset=10_000)["results"] == [] and e.files()["total"] == 5
    assert e.open("lines.md", 2, 3)["content"] == "Line2\nLine3" and e.open("empty.txt")["total_lines"] == 0
    for bad in (("../x.md",), ("/etc/passwd",), ("lines.md", 10, 1), ("lines.md", 9)):
        with pytest.raises(ValueError):
            e.open(*bad)
    with pytest.raises(ValueError):
        e.search(" ")
    with pytest.raises(ValueError):
        e.search("x" * 5000)
    at = {h["doc_id"]: (h["line_start"], h["line_end"]) for h in hits}
    assert at == {"docs/overview.md": (2, 8), "readme.md": (2, 4)}
    assert [(h["line_start"], h["line_end"]) for h in e.search("rel_path:docs/overview.md")] == [(2, 8)]
    assert e.resource("any://lines.md")["total_lines"] == 5
    with e.store.writing(), pytest.raises(IndexBusy):
        e.index()
    assert e.self_check(["NOT_PRESENT"], defaults=False) == []
    (repo / "leak.md").write_text("company SECRET_TOKEN leak")
    (repo / "readme.md").unlink()
    e.ingest(["leak.md", "readme.md", "vendor/private.md"])
    assert [f["paths"] for f in e.self_check(["SECRET_TOKEN"], defaults=False)] == [["leak.md"]]
    assert {h["doc_id"] for h in e.search("roadmap")} == {"docs/overview.md"}
    assert e.stats()["num_docs"] == 5
    log = [json.loads(x) for x in (repo / ".quillspark/audit.log").read_text().splitlines()]
    assert [r["outcome"] for r in log] == ["pass", "fail"] and log[1]["prev_hash"] == log[0]["hash"]


def test_words_of_queries_and_index_agree(spark):
    texts = ["हिन्दी भाषा", "Ελλάδα ΟΔΟΣ", "naïve cafe\u0301", "a_b c-d 3½ Ⅻ", "தமிழ் மொழி", "中文 字", "x²y"]
    from quillspark.operators.index import tokens

    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("w")).collect():
        assert list(Q.words_in(r.t)) == r.w, r.t
    rows = [(str(i), str(i), t, "") for i, t in enumerate(texts)]
    c = Corpus.of(spark.createDataFrame(rows, "doc_id string, rel_path string, body string, summary string"))
    for i, t in enumerate(texts):
        assert str(i) in {r.doc_id for r in matches(c, Q.understand(t, ("body",))).collect()}, t


def test_stretches(spark):
    from quillspark.operators.snippets import best_fragments, fragments

    body = " ".join(f"w{i}" for i in range(3000)) + " needle " + "x" * 50
    d = spark.createDataFrame([("a", body), ("b", ""), ("c", None)], "doc_id string, body string")
    rows = fragments(d, 100).orderBy("doc_id", "frag").collect()
    assert "".join(r.text for r in rows) == body and [r.frag for r in rows] == list(range(len(rows)))
    assert max(len(r.text) for r in rows) <= 101 and len(rows) > 150 and not any(r.text[0] == " " for r in rows)
    assert "<b>needle</b>" in best_fragments(d, {"needle": 1}).collect()[0].html


def test_paths_keep_their_case(spark):
    rows = [(p, p, "x", "") for p in ("Docs/A.md", "docs/a.md", "Docs/Z.md")]
    c = Corpus.of(spark.createDataFrame(rows, "doc_id string, rel_path string, body string, summary string"))
    hits = lambda q: {r.doc_id for r in matches(c, Q.understand(q)).collect()}
    assert hits("rel_path:[Docs/ TO Docs/Y]") == {"Docs/A.md"} and hits("rel_path: IN [docs/a.md Docs/Z.md]") == {"docs/a.md", "Docs/Z.md"}
    assert hits("body:[X TO Y]") == {"Docs/A.md", "docs/a.md", "Docs/Z.md"}


def test_line_ranges(spark):
    body = "one\n\ntwo words\nthree\ntwo again\nend"
    ask = ["two words\nthree", "two\n...\nend", "one\nnowhere", "absent", "", "\n", "one\n", "end"]
    got = spark.createDataFrame([(body, a) for a in ask], "b string, f string").select("f", X.line_range(F.col("b"), F.col("f")).alias("r")).collect()
    assert [r.r and (r.r.line_start, r.r.line_end) for r in got] == [(3, 4), (3, 6), (1, 1), None, None, (1, 1), (1, 1), (6, 6)]


def test_links_out_of_the_root(spark, repo, tmp_path_factory):
    out = tmp_path_factory.mktemp("outside") / "far.md"
    out.write_text("OUTSIDE roadmap")
    e = Engine(spark, str(repo), prefixes=["secret"], state_dir=str(repo / "state"))
    assert e.hidden == "state" and not e.config.wanted("state/x.md")
    e.index()
    (repo / "link.md").symlink_to(out)
    (repo / "near.md").symlink_to(repo / "secret/note.md")
    e.ingest(["link.md", "near.md"])
    assert e.search("OUTSIDE OR SKIPPED_SECRET") == [] and e.is_root(str(repo / "docs/..")) and not e.is_root(str(out.parent))
    long = "\n".join(f"line {i}" for i in range(100))
    (repo / "long.md").write_text(long)
    (repo / "dots.md").write_text("it ends so…")
    e.ingest(["long.md", "dots.md"])
    assert e.snippet("long.md")["snippet"]["truncated"] and not e.snippet("dots.md")["snippet"]["truncated"]
    assert e.snippet("dots.md", off=True)["snippet"] is None and e.snippet("dots.md", "ends", html=False)["snippet"]["html"] is None
    found = e.respond("roadmap", 1)
    assert found["meta"]["repo_root"] == str(repo) and found["meta"]["index_last_updated_epoch_ms"] <= found["meta"]["generated_at_epoch_ms"]


def files_of(spark, d):
    return spark.createDataFrame([(k, bytearray(v.encode())) for k, v in d.items()], "rel_path string, content binary")


def same_answers(spark, store, now, queries=("word1", "shared fresh1", '"shared text"', "-word1 +shared", "*", "rel_path:[1 TO 2]")):
    from quillspark.functions.text import summarize
    from quillspark.operators import index

    whole, c = Corpus.of(index.docs_table(files_of(spark, now), summarize("body"))), store.corpus()
    for q in queries:
        a, b = ({r.doc_id: round(r.score, 9) for r in matches(x, Q.understand(q)).collect()} for x in (c, whole))
        assert a == b, q
    assert c.frequencies("body", ["shared", "text", "absent"]) == whole.frequencies("body", ["shared", "text", "absent"])
    store.release()


def test_segments(spark, tmp_path):
    """Updates write small segments; what is searched is as if all had been indexed at once; small ones are merged, large ones stay; old folders go."""
    s = S.Store(spark, str(tmp_path / "s"))
    with pytest.raises(S.MissingIndex):
        s.manifest()
    now = {f"{i:02}.md": f"word{i % 3} shared text {i}" for i in range(40)}
    base = s.reindex(files_of(spark, now))["segments"][0]["name"]
    for k in range(5):
        more, gone = {f"{k:02}.md": f"fresh{k} shared", f"n{k}.md": "word1 new"}, [f"{20 + k}.md", "absent.md"]
        s.update(files_of(spark, more), gone)
        now = {p: t for p, t in (now | more).items() if p not in gone}
        m = s.manifest()
        assert m["num_docs"] == len(now) == s.stats()["num_docs"] and m["segments"][0]["name"] == base
        if k in (1, 4):
            same_answers(spark, s, now)
    assert len(m["segments"]) <= 3  # four of the small ones are one
    named = {x["name"] for x in m["segments"]}
    assert named <= set(s.folder.names())
    assert s.update(None, ["00.md"])["num_docs"] == len(now) - 1
    now.pop("00.md")
    s.update(files_of(spark, {p: "all shared anew" for p in now}), [])
    same_answers(spark, s, {p: "all shared anew" for p in now})
    assert len(s.manifest()["segments"]) == 1  # more than half was dead


def test_a_change_reads_and_writes_what_it_changes(spark, tmp_path):
    """200 updates of a file write each document a few times, by the classes of sizes."""
    segments, written = [{"docs": 100_000, "dead": 0}], 0
    for k in range(200):
        segments.append({"docs": 1, "dead": k % 2})
        while (start := S.tail_to_merge(segments)) is not None:
            tail = segments[start:]
            docs = sum(x["docs"] for x in tail)
            segments[start:] = [{"docs": docs, "dead": sum(x["dead"] for x in tail)}]
            written += docs
    assert segments[0] == {"docs": 100_000, "dead": 0} and len(segments) < 20 and written <= 200 * (math.log(300, S.FAN) + 1)
    s = S.Store(spark, str(tmp_path / "s"))
    s.write(spark.range(20_000).selectExpr("cast(id as string) doc_id", "cast(id as string) rel_path", "concat('some text of ', id, ' ', repeat('word ', 20)) body", "'' summary", "1L token_estimate"))
    size = lambda name: sum(p.stat().st_size for p in (tmp_path / "s" / name).rglob("*.parquet"))
    m = s.update(files_of(spark, {"17": "another"}), ["18"])
    old, new = m["segments"]
    assert new["docs"] == 1 and new["dead"] == 2 and size(new["name"]) < 20_000 < 10 * size(old["name"]) and m["stats"]["body"] == [19_999, 20_000 * 24 - 2 * 24 + 1]


def test_an_open_search_outlives_commits(spark, tmp_path):
    s, writer = (S.Store(spark, str(tmp_path / "s")) for _ in range(2))
    writer.reindex(files_of(spark, {"a.md": "old words", "b.md": "more words"}))
    c = s.corpus(seconds=300)
    for k in range(4):
        writer.update(files_of(spark, {"a.md": f"new{k}"}))
    assert sorted(r.doc_id for r in matches(c, Q.understand("words")).collect()) == ["a.md", "b.md"]
    assert sorted(r.doc_id for r in matches(s.corpus(c.version), Q.understand("old")).collect()) == ["a.md"]
    kept = lambda: {x for x in s.folder.names() if x.startswith(("seg-", "lease-"))}
    before = kept()
    s.release()
    writer.update(files_of(spark, {"c.md": "x"}))
    writer.update(files_of(spark, {"c.md": "y"}))
    assert len(kept()) < len(before) and not [x for x in kept() if x.startswith("lease-")]
    with pytest.raises(S.MissingIndex):
        s.corpus(c.version)
    gone = S.Store(spark, str(tmp_path / "s"))
    held = gone.corpus(seconds=0.01).version  # a reader that died
    time.sleep(0.05)
    for k in range(2):
        writer.update(files_of(spark, {"d.md": f"{k}"}))
    assert held not in writer._manifests() and not [x for x in kept() if x.startswith("lease-")]


def test_a_lock_that_runs_out_is_taken_over(spark, tmp_path, monkeypatch):
    """As outside a local folder: the writer renews its lock, a dead one's is moved away, and who lost it commits nothing."""
    s, other = (S.Store(spark, str(tmp_path / "s")) for _ in range(2))
    s.folder.local = other.folder.local = None
    s.reindex(files_of(spark, {"a.md": "one"}))
    monkeypatch.setattr(S, "LOCK_SECONDS", 0.6)
    with s.writing():
        time.sleep(1)  # renewed
        with pytest.raises(IndexBusy):
            other.update(files_of(spark, {"b.md": "two"}))
    dead = S.Lock(other.folder, 0.2)
    dead.done.set()  # it renews nothing
    dead.acquire()
    with pytest.raises(IndexBusy):
        s.update(None, ["a.md"])
    time.sleep(0.3)
    assert s.update(files_of(spark, {"b.md": "two"}))["num_docs"] == 2
    with pytest.raises(IndexBusy):
        dead.check()
    with s.writing():
        other.folder.put("writer.lock", json.dumps({"owner": "another", "until": 0}))
        with pytest.raises(IndexBusy):
            s._commit(99, [], {}, {})
    assert 99 not in s._manifests()


def test_ranges_that_cannot_reach_the_top_are_left_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SEARCH, "FEW_RANGES", 20)
    s = S.Store(spark, str(tmp_path / "s"))
    body = "concat('common ', case when id % 997 = 3 then 'common common rare' when id % 50 = 0 then 'common other ' else repeat('filler ', 5 + cast(id % 7 as int)) end, ' w', id % 11)"
    docs = spark.range(6000).selectExpr("lpad(id, 5, '0') doc_id", "lpad(id, 5, '0') rel_path", f"{body} body", "'' summary", "1L token_estimate")
    s.write(docs)
    s.change(docs.where("doc_id in ('00003', '01000')").withColumn("body", F.lit("filler")), None)
    c = s.corpus()
    assert c.blocks.where("field = 'body' and term = 'common'").agg(F.max("n")).first()[0] == 128
    for q, k in (("common", 5), ("common rare", 5), ("+common other^3", 10), ("common -rare", 9), ("(common OR w3) AND w5", 4)):
        tree = Q.understand(q, ("body",))
        ranges = SEARCH.reaching(c, tree, k)
        few = matches(c if ranges is None else c.only(ranges), tree).orderBy(F.desc("score"), "doc_id").limit(k).collect()
        assert few == matches(c, tree).orderBy(F.desc("score"), "doc_id").limit(k).collect() and len(few) == k, q
        if q in ("common", "common rare"):  # what is scored falls
            assert c.only(ranges).hits.where("field = 'body' and term = 'common'").count() < 1500
    assert SEARCH.reaching(c, Q.understand('"common other"'), 3) is None and SEARCH.reaching(c, Q.understand("absent"), 3) is None
    assert {(r.term, r.df, r.cf) for r in c.terms.where("field = 'body' and term in ('rare', 'other')").collect()} == {("rare", 5, 5), ("other", 119, 119)}


def test_live_index(spark, repo, tmp_path_factory):
    e = Engine(spark, str(repo), prefixes=["secret"])
    e.index()
    q = e.watch(str(tmp_path_factory.mktemp("cp")))

    def waits(test):
        end = time.time() + 60
        while time.time() < end and not test():
            time.sleep(0.5)
        return test()

    try:
        (repo / "live.md").write_text("PERISCOPE roadmap")
        assert waits(lambda: [h["doc_id"] for h in e.search("PERISCOPE")] == ["live.md"])
        (repo / "live.md").unlink()
        (repo / "other.md").write_text("PERISCOPE two")
        assert waits(lambda: [h["doc_id"] for h in e.search("PERISCOPE")] == ["other.md"])
    finally:
        q.stop()


def test_audit_finds_edited_records(spark, tmp_path):
    from quillspark.operators.audit import damaged

    a, b = AuditLog(str(tmp_path / "a.log")), AuditLog(str(tmp_path / "a.log"))
    for i in range(6):
        (a if i % 2 else b).append("self_check", "pass", n="x" * 3000 * (i % 3))
    rows = [json.loads(x) for x in a.path.read_text().splitlines()]
    assert [r["prev_hash"] for r in rows] == [None, *(r["hash"] for r in rows[:-1])]
    lines = a.path.read_text().splitlines()
    lines[2] = lines[2].replace('"pass"', '"fail"')
    a.path.write_text("\n".join([*lines, "no json"]) + "\n")
    assert [r.intact for r in damaged(spark.read.text(str(a.path)).coalesce(1)).collect()] == [True, True, False, True, True, True, False]


def test_audit_rotation(tmp_path):
    a = AuditLog(str(tmp_path / "a.log"), most_bytes=1)
    first = a.append("x", "ok")
    assert a.append("y", "ok")["prev_hash"] == first["hash"] and (tmp_path / "a.log.1").exists()
    assert AuditLog(str(tmp_path / "a.log")).last == a.last


def test_rate_limit(spark):
    d = spark.createDataFrame([(1, 0.0, 1), (1, 0.1, 2), (1, 0.2, 3), (1, 31.0, 4), (2, 0.0, 5)], "k int, s double, i int")
    assert [r.allowed for r in rate_limited(d, "k", "s", "i", 2, 2).orderBy("i").collect()] == [True, True, False, True, True]
    assert all(r.allowed for r in rate_limited(d, "k", "s", "i", 0).collect()) and all(r.allowed for r in rate_limited(d, "k", "s", "i", 0, secure=True).collect())
    many = spark.createDataFrame([(None if i % 3 == 0 else i % 3, float(i // 3), i) for i in range(9000)], "k int, s double, i int")
    got = {(r.k, r.i) for r in rate_limited(many, "k", "s", "i", 2, 2).where("allowed").collect()}
    want = set()
    for k in (None, 1, 2):
        held, last = 2.0, 0.0
        for s_, i in sorted((float(i // 3), i) for i in range(9000) if (None if i % 3 == 0 else i % 3) == k):
            held, last = min(2.0, held + (s_ - last) * (2 / 60)), s_
            if held >= 1:
                held -= 1
                want.add((k, i))
    assert got == want


def test_resolve(spark):
    d = spark.createDataFrame([("a", "1", 1, False), ("a", "2", 2, False), ("b", "1", 1, False), ("b", None, 2, True)], "doc_id string, body string, seq long, deleted boolean")
    assert [(r.doc_id, r.body) for r in resolve(d).collect()] == [("a", "2")]


def test_change_stream(spark, repo, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    q = apply_changes(changes(spark, str(repo), prefixes=["secret"]), str(out / "v"), str(out / "cp"))

    def live():
        try:
            return {r.doc_id for r in resolve(spark.read.parquet(str(out / "v")).drop("batch")).collect()}
        except Exception:
            return set()

    def waits(test):
        end = time.time() + 40
        while time.time() < end and not test(live()):
            time.sleep(0.5)
        return test(live())

    try:
        assert waits(lambda x: "readme.md" in x)
        (repo / "readme.md").unlink()
        (repo / "new.md").write_text("new")
        assert waits(lambda x: "readme.md" not in x and "new.md" in x)
    finally:
        q.stop()


def test_a_file_that_is_gone(spark, tmp_path):
    """It is left out of a scan and of an ingest, and left to its deletion in a stream; it never becomes an empty document."""
    from quillspark.sources.tree import contents

    (tmp_path / "a.md").write_text("here")
    got = contents(spark.createDataFrame([("a.md",), ("gone.md",)], "rel_path string"), str(tmp_path)).collect()
    assert {r.rel_path: r.content for r in got} == {"a.md": bytearray(b"here"), "gone.md": None}


def test_listing_by_versions(tmp_path):
    """Small offsets, the same rows again after a failure, unchanged folders not listed, edits of equal size found."""
    from quillspark.sources import tree as T

    root, listing = tmp_path / "r", tmp_path / "l"
    for rel in ("a.md", "x/b.md", "x/y/c.md", "x/y/z/d.md", "x/skip.rs", "vendor/no.md"):
        (root / rel).parent.mkdir(parents=True, exist_ok=True)
        (root / rel).write_text(rel)
    for d in (root, root / "x", root / "x/y", root / "x/y/z"):
        os.utime(d, (1, 1))  # long ago
    reader = lambda: T._Changes(str(root), str(listing), Config.of())
    rows = lambda r, a, b: sorted((op, rel) for p in r.partitions({"version": a}, {"version": b}) for op, rel, _ in r.read(p))
    r = reader()
    assert r.initialOffset() == {"version": 0} and r.latestOffset() == {"version": 1}
    first = rows(r, 0, 1)
    assert first == [("upsert", x) for x in ("a.md", "x/b.md", "x/y/c.md", "x/y/z/d.md")]
    assert rows(reader(), 0, 1) == first and reader().latestOffset() == {"version": 2}
    listed, plain = [], os.scandir
    T.os.scandir = lambda p: listed.append(os.path.relpath(p, root)) or plain(p)
    try:
        (root / "x/y/z/d.md").write_text("X/y/z/d.m"[: len("x/y/z/d.md")].ljust(len("x/y/z/d.md")))  # as long as before
        assert rows(r, 1, 2) == [("upsert", "x/y/z/d.md")] and not any("y" in x for x in listed)
        (root / "x/b.md").rename(root / "x/y/e.md")
        assert rows(r, 2, 3) == [("delete", "x/b.md"), ("upsert", "x/y/e.md")] and "x/y" in listed and "x/y/z" not in listed
    finally:
        T.os.scandir = plain
    shutil.rmtree(root / "x/y")
    assert rows(r, 3, 4) == [("delete", x) for x in ("x/y/c.md", "x/y/e.md", "x/y/z/d.md")]
    r.commit({"version": 4})
    assert rows(r, 4, 5) == [] == rows(reader(), 4, 5) and {p.name for p in (listing / "versions").glob("*")} == {"4.json", "5.json"}
    (root / "a.md").write_text("later")
    assert rows(reader(), 4, 5) == []  # that batch is done: what comes later is the next one's
    assert rows(reader(), 5, 6) == [("upsert", "a.md")] and not list(listing.glob("subtrees/*/5.json"))


def test_pages_read_few_files(spark, tmp_path):
    s = S.Store(spark, str(tmp_path / "s"))
    made = lambda df: df.selectExpr("lpad(id, 5, '0') doc_id", "lpad(id, 5, '0') rel_path", "'b' body", "'' summary", "1L token_estimate")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that tables have several files
    try:
        s.write(made(spark.range(0, 4000, 2)))
        s.change(made(spark.range(0, 900, 3)), spark.range(100, 3000, 4).selectExpr("lpad(id, 5, '0') doc_id"))
        s.change(made(spark.range(3999, 4010)), None)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    m = s.manifest()
    assert len(m["segments"]) == 3 and len(m["segments"][0]["files"]["docs"]) == 4
    want = sorted(({*range(0, 4000, 2)} - {*range(100, 3000, 4)}) | {*range(0, 900, 3)} | {*range(3999, 4010)})
    assert m["num_docs"] == len(want)
    for offset, limit in ((0, 5), (300, 40), (700, 3), (len(want) - 4, 10), (len(want), 5), (10_000, 5), (0, 10_000)):
        assert [int(r.doc_id) for r in s.page(offset, limit).collect()] == want[offset : offset + limit], (offset, limit)
    scanned = s.page(len(want) - 20, 5)
    assert "GreaterThanOrEqual(doc_id," in scanned._jdf.queryExecution().executedPlan().toString()
    empty = S.Store(spark, str(tmp_path / "e"))
    empty.write(made(spark.range(0)))
    assert empty.page(0, 5).collect() == [] == empty.page(3, 5).collect()
