"""The engine for one document tree: index, search, snippets, files, open, statistics, self-check."""

from __future__ import annotations

import hashlib
import json
import os
import time
from datetime import datetime, timezone
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import line_range
from quillspark.operators import query
from quillspark.operators.audit import AuditLog
from quillspark.operators.snippets import best_fragments, preview, preview_lines, preview_truncated, window_lines
from quillspark.plans.search import Corpus, matches, search
from quillspark.plans.store import MissingIndex, Store
from quillspark.sources import config as C
from quillspark.sources.tree import changes, contents, scan
from quillspark.streaming.upserts import keep_fresh


def _terms(tree) -> set[str]:
    if isinstance(tree, query.Term):
        return set(tree.words)
    return set().union(*(_terms(t) for t in (*tree.should, *tree.must))) if isinstance(tree, query.Bool) else set()


class Engine:
    def __init__(self, spark: SparkSession, root: str, names=(), prefixes=(), state_dir: str = ".quillspark"):
        self.spark, self.root = spark, Path(root).resolve()
        self.names, self.prefixes = names, prefixes
        self.state = Path(state_dir) if Path(state_dir).is_absolute() else self.root / state_dir
        inside = self.state.resolve()
        # What the scan leaves out is a path below the root, however the state folder was given.
        self.hidden = str(inside.relative_to(self.root)) if inside.is_relative_to(self.root) else state_dir
        self.config = C.Config.of(names, prefixes, self.hidden)
        self.store, self.audit = Store(spark, str(self.state)), AuditLog(str(self.state / "audit.log"))

    def index(self) -> dict:
        return self.store.reindex(scan(self.spark, str(self.root), self.names, self.prefixes, self.hidden))

    def watch(self, checkpoint: str, every: str = "1 second"):
        """A streaming query that keeps the index fresh: what changes in the tree is committed, and searches read it from then on."""
        listing = self.state / "listing" / hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
        stream = changes(self.spark, str(self.root), self.names, self.prefixes, self.hidden, str(listing))
        return keep_fresh(self.store, stream, checkpoint, every)

    def ingest(self, paths: list[str]) -> dict:
        """Paths that are left out by the rules, or lead out of the root through links, change nothing; an empty list indexes all."""
        if not paths:
            return self.index()
        found = [p for p in map(C.normalize_rel, paths) if p and self.config.wanted(p)]
        inside = {p: self._inside(p) for p in found}
        rows = [(p,) for p, at in inside.items() if at is not None and at.is_file()]
        gone = [p for p in found if not os.path.lexists(self.root / p)]
        files = contents(self.spark.createDataFrame(rows, "rel_path string"), str(self.root)).where("content is not null") if rows else None
        return self.store.update(files, gone)

    def _inside(self, rel: str) -> Path | None:
        """The path with its links followed, if it is still within the root and isn't left out there."""
        at = (self.root / rel).resolve()
        if not at.is_relative_to(self.root):
            return None
        return at if at == self.root / rel or self.config.wanted(str(at.relative_to(self.root))) else None

    def is_root(self, path: str) -> bool:
        """Whether a project root that a caller names is this engine's, links followed."""
        return Path(path).resolve() == self.root

    def respond(self, text: str, limit: int | None = None, **options) -> dict:
        """search() with what the answer was made from."""
        try:
            updated = self.store.manifest()["commit_ms"]
        except MissingIndex:
            updated = None
        return {"hits": self.search(text, limit, **options), "meta": {"generated_at_epoch_ms": int(time.time() * 1000), "index_last_updated_epoch_ms": updated, "repo_root": str(self.root)}}

    def search(self, text: str, limit: int | None = None, most: int = C.DEFAULT_LIMIT, max_tokens: int | None = None, snippets: bool = True, surface: str = "api") -> list[dict]:
        """Hits, best first, with a snippet and its lines: the best stretch for the words, else a preview, else the summary (no lines)."""
        if not text.strip():
            raise ValueError("query must not be empty")
        if len(text.encode()) > C.QUERY_BYTES:
            raise ValueError("query is too long")
        c = self.store.corpus()
        hits = search(c, text, C.resolve_limit(surface, limit, most), max_tokens=max_tokens)
        top = hits.orderBy(F.desc("score"), "doc_id").select("doc_id", "rel_path", "score", "summary", "token_estimate", preview(F.col("body")).alias("preview"), preview_lines(F.col("body")).alias("preview_lines")).collect()
        found = self._snippets(c, [r.doc_id for r in top], query.understand(text)) if snippets else {}
        out = []
        for r in top:
            hit, own = r.asDict(), found.get(r.doc_id)
            shown, at = hit.pop("preview"), hit.pop("preview_lines")
            if own:
                shown, start, end = own["snippet"], own["line_start"], own["line_end"]
            else:
                start, end = (at.line_start, at.line_end) if shown else (None, None)
            out.append({**hit, "snippet": (shown or r.summary) if snippets else "", "line_start": start, "line_end": end})
        return out

    def _snippets(self, c: Corpus, ids: list[str], tree) -> dict[str, dict]:
        terms = _terms(tree)
        if not ids or not terms:
            return {}
        df = c.frequencies("body", sorted(terms))
        few = c.docs.where(F.col("doc_id").isin(ids))
        best = best_fragments(few, {t: df.get(t, 0) for t in terms}).join(few.select("doc_id", "body"), "doc_id")
        rows = best.select("doc_id", "snippet", "html", line_range(F.col("body"), F.col("snippet")).alias("at")).collect()
        return {r.doc_id: {"snippet": r.snippet, "html": r.html, "origin": "query", "truncated": False, "line_start": r.at and r.at.line_start, "line_end": r.at and r.at.line_end} for r in rows}

    def snippet(self, doc_id: str, text: str | None = None, window: int = C.WINDOW_DEFAULT, max_tokens: int | None = None, html: bool = True, off: bool = False) -> dict:
        """A document and the best stretch for `text`, else its first lines. html=False: no markup; off: no snippet at all."""
        c = self.store.corpus()
        row = c.docs.where(F.col("doc_id") == doc_id).select("doc_id", "rel_path", "summary", "token_estimate", preview(F.col("body"), window_lines(window)).alias("p"), preview_lines(F.col("body"), window_lines(window)).alias("at"), preview_truncated(F.col("body"), window_lines(window)).alias("cut")).limit(1).collect()
        if not row:
            return {"doc": None, "snippet": None}
        doc = row[0].asDict()
        shown, at, cut = doc.pop("p"), doc.pop("at"), doc.pop("cut")
        if off:
            return {"doc": doc, "snippet": None}
        if max_tokens is not None and doc["token_estimate"] > max_tokens:
            return {"doc": doc, "snippet": None}
        found = None
        if text and text.strip():
            try:  # one parse over the body, without the ladder
                found = self._snippets(c, [doc_id], query.parse(text, ("body",))).get(doc_id)
            except query.QueryError:
                pass
        out = dict({**found, "line_start": None, "line_end": None} if found else {"snippet": shown, "html": None, "origin": "preview", "truncated": cut, "line_start": at["line_start"], "line_end": at["line_end"]})
        if not html:
            out["html"] = None
        return {"doc": doc, "snippet": out}

    def files(self, limit: int = C.FILES_DEFAULT, offset: int = 0) -> dict:
        limit, offset = max(1, min(C.FILES_MOST, limit)), max(0, min(C.OFFSET_MOST, offset))
        c = self.store.corpus()
        page = [r.asDict() for r in self.store.page(offset, limit, c.version).select("doc_id", "rel_path", "summary", "token_estimate").collect()]
        return {"results": page, "total": self.store.manifest(c.version)["num_docs"], "limit": limit, "offset": offset, "repo_root": str(self.root)}

    def open(self, path: str, start: int | None = None, end: int | None = None) -> dict:
        rel = C.normalize_rel(path)
        p = (self.root / (rel or "")).resolve()
        if not p.is_relative_to(self.root) or not p.is_file():
            raise ValueError("path must be a file within the root")
        if p.stat().st_size > C.OPEN_BYTES:
            raise ValueError("file is too large")
        ls = p.read_text(errors="replace").split("\n")
        ls = [x.removesuffix("\r") for x in (ls[:-1] if ls[-1] == "" else ls)]
        if not ls:
            return {"path": rel, "start_line": 0, "end_line": 0, "total_lines": 0, "content": ""}
        s, e = max(1, start or 1), len(ls) if end is None else end
        for bad, say in ((e < s, "end is before start"), (s > len(ls), "start is past the end"), (e > len(ls), "end is past the end")):
            if bad:
                raise ValueError(say)
        return {"path": rel, "start_line": s, "end_line": e, "total_lines": len(ls), "content": "\n".join(ls[s - 1 : e])}

    def resource(self, uri: str) -> dict:
        """open() by scheme://path."""
        scheme, _, path = uri.partition("://")
        if not scheme or not path:
            raise ValueError("not a resource URI")
        return self.open(path)

    def stats(self) -> dict:
        return self.store.stats()

    def self_check(self, terms: list[str] = (), limit: int = 5, defaults: bool = True) -> list[dict]:
        """A finding for each term with a hit; a report in the state folder and one audit record either way."""
        asked = [t.strip() for t in terms if t.strip()]
        asked += [t for t in C.SENSITIVE_TERMS if defaults and t.lower() not in {x.lower() for x in asked}]
        c, found = self.store.corpus(), {}
        if asked:
            parts = [matches(c, query.understand(t)).withColumn("term", F.lit(t)) for t in asked]
            place = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "doc_id"))
            for r in reduce(DataFrame.unionByName, parts).withColumn("place", place).where(F.col("place") <= limit + 1).orderBy("term", "place").collect():
                found.setdefault(r.term, []).append(r.doc_id)
        findings = [{"term": t, "paths": found[t][:limit], "more": len(found[t]) > limit} for t in asked if t in found]
        (self.state / "self_check_report.json").write_text(json.dumps({"repo": str(self.root), "checked_at": datetime.now(timezone.utc).isoformat(), "findings": findings}))
        self.audit.append("self_check", "fail" if findings else "pass")
        return findings
