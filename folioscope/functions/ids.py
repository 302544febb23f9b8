"""Deterministic identities and names as Column expressions, and the few that are made on the driver."""

from __future__ import annotations

import hashlib
import posixpath
from dataclasses import dataclass, replace
from urllib.parse import urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of names and fingerprints.
NAME_LENGTH = 24
ALIAS_PREFIX = "alias_"
FNV64_OFFSET = 14695981039346656037
FNV64_PRIME = 1099511628211
INPUT_FORMAT_VERSION = 1


def sha_of(*parts: Column | str) -> Column:
    """Lower-hex SHA-256 of the parts joined by NUL; a null part counts as empty."""
    as_text = [F.coalesce((F.lit(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("\0", *as_text), 256)


def content_hash(markdown: Column) -> Column:
    return F.sha2(markdown, 256)


def artifact_document_id(source: Column, version: Column, url: Column) -> Column:
    return sha_of(source, version, url)


def document_filename(document_id: Column) -> Column:
    return F.concat(F.lit("documents/"), F.left(document_id, F.lit(24)), F.lit(".md"))


def chunk_point_id(source: Column, version: Column, url: Column, content: Column, index: Column) -> Column:
    return sha_of(source, version, url, content, index)


def store_document_id(source: Column, url: Column) -> Column:
    """Without the version: each version has its own snapshot."""
    return sha_of("document", source, url)


def stored_point_id(digest: Column) -> Column:
    """The first 32 hex digits, hyphenated 8-4-4-4-12."""
    bounds = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *(F.substring(digest, a, n) for a, n in bounds))


def safe_name(text: Column) -> Column:
    kept = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]", "_"), "^_+|_+$", "")
    return F.left(F.when(F.coalesce(kept, F.lit("")) == "", "source").otherwise(kept), F.lit(NAME_LENGTH))


def safe_path(text: Column) -> Column:
    """For directory names: separators and parent steps are replaced."""
    return F.replace(F.replace(F.replace(text, F.lit("/"), F.lit("_")), F.lit("\\"), F.lit("_")), F.lit(".."), F.lit("_"))


def fnv1a64(data: bytes) -> int:
    value = FNV64_OFFSET
    for byte in data:
        value = (value ^ byte) * FNV64_PRIME % 2**64
    return value


def py_safe_name(text: str) -> str:
    kept = "".join(c if c.isascii() and c.isalnum() else "_" for c in text.lower()).strip("_")
    return (kept or "source")[:NAME_LENGTH]


def alias_name(source: str, version: str | None) -> str:
    """The alias of a source's version; without version, of the source's default."""
    label = py_safe_name(version) if version else "default"
    digest = fnv1a64(f"{source}\0{version or ''}".encode())
    return f"{ALIAS_PREFIX}{py_safe_name(source)}_{label}_{f'{digest:016x}'[:10]}"


def physical_prefix(source: str) -> str:
    return f"{py_safe_name(source)}__"


def physical_name(source: str, version: str | None, nanos: int, nonce: str) -> str:
    label = py_safe_name(version) if version else "unversioned"
    return f"{physical_prefix(source)}{label}__snapshot_{nanos}_{nonce}"


def normal_endpoint(endpoint: str) -> str:
    """Lower-case scheme and host, cleaned path, no query, fragment or final slash; other text only loses final slashes."""
    text = endpoint.strip()
    try:
        url = urlsplit(text)
    except ValueError:
        return text.rstrip("/")
    if not url.scheme or not url.netloc:
        return text.rstrip("/")
    user, at, host = url.netloc.rpartition("@")
    path = posixpath.normpath("/" + url.path.lstrip("/")).rstrip("/") if url.path else ""
    return f"{url.scheme.lower()}://{user}{at}{host.lower()}{path}"


def profile_fingerprint(provider: str, endpoint: str, model: str, input_type: str, input_format_version: int = 0) -> str:
    """What an embedding depends on, as one hash; format version 0 means 1."""
    lines = {
        "provider": provider.strip().lower(), "endpoint": normal_endpoint(endpoint), "model": model.strip(),
        "input_type": input_type.strip(), "input_format": str(input_format_version or INPUT_FORMAT_VERSION),
    }
    return hashlib.sha256("\n".join(f"{k}={v}" for k, v in lines.items()).encode()).hexdigest()


@dataclass(frozen=True)
class EmbeddingProfile:
    """What an embedding depends on. Vectors are reused only under an equal fingerprint."""

    provider: str = ""
    endpoint: str = ""
    model: str = ""
    input_type: str = "document"
    input_format_version: int = 0

    def for_model(self, model: str) -> EmbeddingProfile:
        """With ``model`` where the profile names none."""
        return self if self.model else replace(self, model=model)

    def fingerprint(self) -> str:
        return profile_fingerprint(self.provider, self.endpoint, self.model, self.input_type or "document", self.input_format_version)
