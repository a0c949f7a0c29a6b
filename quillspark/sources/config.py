"""Limits and exclusion rules of a document tree."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import PurePosixPath

#: File kinds that are indexed.
EXTENSIONS = (".md", ".markdown", ".mdx", ".txt")
#: Folder or file names left out by default, and path prefixes. More are given as settings; the state folder is a prefix too.
EXCLUDED_NAMES = (
    ".git", ".idea", ".vscode", ".cache", "tmp", "temp", ".hg", ".svn",
    "node_modules", ".pnpm-store", ".yarn", ".yarn-cache", ".npm", "dist", "build", "coverage", ".vite", ".turbo", ".nx", ".parcel-cache", ".rollup-cache", ".webpack-cache", ".tsbuildinfo", ".next", ".nuxt", ".svelte-kit", ".angular", ".expo",
    "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".ipynb_checkpoints",
    "target", ".cargo", "bin", "pkg", "go-build", ".gradle", ".mvn", "out", "obj", ".vs", "deriveddata", "vendor", ".bundle",
    ".dart_tool", ".flutter-plugins", ".flutter-plugins-dependencies", ".pub-cache", ".android", "pods",
    "debug", "release", "cmake-build-debug", "cmake-build-release", "cmakefiles", ".conan", "vcpkg_installed",
    ".stack-work", "dist-newstyle", "cabal-dev", "_build", "deps", ".elixir_ls", ".bloop", ".metals", ".cpcache", "elm-stuff", "nimcache", "_opam", ".rproj.user",
    "library", "logs", "binaries", "deriveddatacache", "intermediate", ".godot",
    ".docker", "docker-data", ".terraform", ".serverless", ".vercel", ".netlify",
)
EXCLUDED_PREFIXES = ("logs/", "docker/.data/", "docker-data/", ".docker/")
DEFAULT_LIMIT, FILES_DEFAULT, FILES_MOST, OFFSET_MOST = 8, 200, 1000, 50_000
OPEN_BYTES = 512 * 1024
QUERY_BYTES, REQUEST_BYTES = 4096, 16384
WINDOW_DEFAULT, WINDOW_LEAST, WINDOW_MOST, PREVIEW_LINES = 40, 10, 400, 60
SENSITIVE_TERMS = ("SECRET_TOKEN", "API_KEY", "PRIVATE KEY", "-----BEGIN PRIVATE KEY-----", "PASSWORD", "ACCESS_TOKEN")


def normalize_prefix(p: str) -> str:
    p = p.replace("\\", "/").strip().lstrip("/").lower()
    return p if not p or p.endswith("/") else p + "/"


def normalize_rel(p: str) -> str | None:
    """A relative path without '.' parts; ValueError for absolute ones and '..'; None if nothing is left."""
    if p.startswith("/") or ".." in p.split("/"):
        raise ValueError("path must be relative and within the root")
    return "/".join(x for x in p.split("/") if x not in ("", ".")) or None


def resolve_limit(surface: str, asked: int | None, most: int) -> int:
    limit = DEFAULT_LIMIT if asked is None else asked
    if limit < 1:
        raise ValueError("limit must be 1 or more")
    return limit if surface == "cli" else min(limit, most)


@dataclass(frozen=True)
class Config:
    names: tuple[str, ...] = EXCLUDED_NAMES
    prefixes: tuple[str, ...] = (*EXCLUDED_PREFIXES, ".quillspark/")
    state_dir: str = ".quillspark"

    @classmethod
    def of(cls, names=(), prefixes=(), state_dir=".quillspark") -> Config:
        more = tuple(x.strip().lower() for x in names if x.strip())
        return cls(tuple(dict.fromkeys(EXCLUDED_NAMES + more)), tuple(dict.fromkeys(p for p in map(normalize_prefix, (*EXCLUDED_PREFIXES, *prefixes, state_dir)) if p)), state_dir)

    def wanted(self, rel_path: str) -> bool:
        """Order: prefixes, then any component, then the kind of file."""
        low = rel_path.replace("\\", "/").lstrip("/").lower()
        if any(low.startswith(p) for p in self.prefixes) or any(part in self.names for part in low.split("/")):
            return False
        return PurePosixPath(low).suffix in EXTENSIONS

    def wanted_dir(self, rel_dir: str) -> bool:
        low = rel_dir.lower().strip("/") + "/"
        return not any(low.startswith(p) for p in self.prefixes) and not any(part in self.names for part in low.strip("/").split("/"))
