"""Path classification columns. Paths are ``/``-separated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewarden.functions.globs import any_glob

# What makes a path sensitive.
SECRET_FILENAMES = [
    ".env",
    ".netrc",
    "_netrc",
    ".npmrc",
    ".pypirc",
    ".dockercfg",
    ".git-credentials",
    "id_rsa",
    "id_dsa",
    "id_ecdsa",
    "id_ed25519",
    "credentials",
    "credentials.json",
    "secrets.yaml",
    "secrets.yml",
]
SECRET_EXTENSIONS = ["pem", "key", "p12", "pfx", "jks", "keystore", "ppk"]
SECRET_DIRS = [".ssh", ".aws", ".gnupg", ".kube", ".docker", ".config/gcloud", ".config/gh"]

# Text formats that may hold endpoint configuration.
TEXT_EXTENSIONS = [
    "json", "yaml", "yml", "toml", "js", "mjs", "cjs", "ts", "log", "cfg", "conf", "ini", "txt", "env",
]

# Formats whose entropy is legitimately high.
COMPRESSED_EXTENSIONS = [
    "mp4", "mov", "m4v", "avi", "mkv", "webm", "mp3", "m4a", "wav", "flac", "aac", "ogg", "opus",
    "png", "jpg", "jpeg", "gif", "webp", "heic", "avif", "ico", "bmp", "tiff", "psd", "svgz",
    "zip", "gz", "tgz", "xz", "bz2", "7z", "rar", "zst", "lz4", "br", "jar", "war", "apk", "ipa",
    "pdf", "epub", "mobi", "docx", "xlsx", "pptx", "db", "sqlite", "sqlite3", "db-wal", "db-shm",
    "ldb", "sst", "pack", "idx", "bitmap", "dylib", "so", "dll", "a", "o", "obj", "lib", "exe",
    "wasm", "node", "rlib", "rmeta", "woff", "woff2", "ttf", "otf", "eot", "icns", "class",
]
COMPRESSED_NEEDLES = ["/objects/pack/", "/.git/", "/node_modules/"]

# Directories counted for size but not searched for endpoints.
SKIP_SCAN_DIRS = [
    "plugins", "marketplaces", "marketplace", "extensions", "node_modules", ".git", "templates",
    ".github", "skills", "skill", "cache", "caches", "tmp", "temp", "logs", "sessions", "history",
    "projects", "tool-results", "conversations", "threads", "chats", "vendor", "dist",
    "site-packages",
]


def file_name(path: Column) -> Column:
    return F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the file name; empty for names such as ``.pem`` or ``a``."""
    return F.lower(F.regexp_extract(file_name(path), r"(?s)^.+\.([^.]*)$", 1))


def is_git_path(path: Column) -> Column:
    return F.array_contains(F.split(path, "/"), ".git")


def classify_path(path: Column, extra_globs: tuple[str, ...] | list[str] = ()) -> Column:
    """``git-metadata``, ``secret`` or null. Git metadata wins."""
    name = F.lower(file_name(path))
    secret = name.isin(SECRET_FILENAMES) | name.startswith(".env.") | extension(path).isin(SECRET_EXTENSIONS)
    for directory in SECRET_DIRS:
        secret = secret | path.contains(f"/{directory}/")
    if extra_globs:
        secret = secret | path.rlike(any_glob(list(extra_globs)))
    return F.when(is_git_path(path), F.lit("git-metadata")).when(secret, F.lit("secret"))


def is_known_compressed(path: Column) -> Column:
    out = extension(path).isin(COMPRESSED_EXTENSIONS)
    for needle in COMPRESSED_NEEDLES:
        out = out | path.contains(needle)
    return out


def is_text_candidate(path: Column) -> Column:
    """A text format by extension, or a bare ``.env``."""
    return extension(path).isin(TEXT_EXTENSIONS) | (F.lower(file_name(path)) == ".env")


def is_under(path: Column, directory: Column) -> Column:
    """Component-wise prefix: the directory itself or anything below it."""
    base = F.rtrim(directory, F.lit("/"))
    return (path == base) | (path == directory) | path.startswith(F.concat(base, F.lit("/")))
