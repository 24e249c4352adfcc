"""Driver-side access to remote sources: never used by an executor, never implicitly.

Each function takes ``get(url, timeout)``, which returns (status, headers, reader);
the default uses the standard library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
from collections.abc import Callable
from dataclasses import asdict, dataclass
from urllib.error import HTTPError
from urllib.parse import quote, urlsplit, urlunsplit
from urllib.request import Request, urlopen

from kelvinlake.errors import AmbiguousComponent, ComponentNotFound, DownloadError, ParseError, ResolverError, SourceError
from kelvinlake.operators.identity import Identity, normal
from kelvinlake.sources import scan

# fixed values: limits and the external resolver's interface
MOST_BYTES, METADATA_BYTES, RESOLVER_BYTES = 100 << 20, 10 << 20, 2 << 20
SUFFIXES = (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz2", ".tar.xz", ".txz")
RESOLVER = "https://pubchem.ncbi.nlm.nih.gov/rest/pug/compound"
RESOLVER_FIELDS = "Title,IUPACName,MolecularFormula,InChI,InChIKey"
NAMESPACES = ("name", "cid", "smiles", "inchikey", "formula")
Get = Callable[[str, float], tuple]


def _default_get(url: str, timeout: float):
    try:
        response = urlopen(Request(url, headers={"User-Agent": "kelvinlake"}), timeout=timeout)  # noqa: S310 - https is checked
    except HTTPError as e:
        return e.code, dict(e.headers or {}), e
    return response.status, dict(response.headers), response


def check_https(url: str) -> str:
    parts = urlsplit(url)
    if parts.scheme != "https" or not parts.netloc:
        raise SourceError(f"{url!r} is no absolute HTTPS URL")
    return url


def download(url: str, *, timeout: float = 30, most: int = MOST_BYTES, get: Get = _default_get) -> bytes:
    try:
        check_https(url)
        status, headers, reader = get(url, timeout)
        declared = {k.lower(): v for k, v in headers.items()}.get("content-length")
        if status >= 400:
            raise DownloadError(f"{url}: HTTP status {status}")
        if declared is not None and int(declared) > most:
            raise DownloadError(f"{url} declares {declared} bytes; the limit is {most}")
        data = reader.read(most + 1)
    except (OSError, ValueError, SourceError) as e:
        raise DownloadError(f"{url}: {e}") from e
    if len(data) > most:
        raise DownloadError(f"{url} has more than {most} bytes")
    return data


def load_url(spark, url: str, *, timeout: float = 30, most: int = MOST_BYTES, json_fallback: bool = True, get: Get = _default_get):
    """The decoded document of a URL; an XML that can't be parsed falls back to the JSON
    of the same path, if that names the XML's MD5."""
    data = download(url, timeout=timeout, most=most, get=get)
    out = scan.decode_documents(spark.createDataFrame([(0, url, None, data) if data.lstrip()[:1] == b"{" else (0, url, data, None)], scan.BRONZE))
    error = out.select("error").first()["error"]
    if error is None:
        return out
    parts = urlsplit(url)
    if not (json_fallback and error["kind"] == "ParseError" and parts.path.lower().endswith(".xml")):
        raise ParseError(error["message"])
    twin = download(urlunsplit(parts._replace(path=parts.path[:-4] + ".json")), timeout=timeout, most=most, get=get)
    out = scan.decode_documents(spark.createDataFrame([(0, url, data, twin)], scan.BRONZE))
    error = out.select("error").first()["error"]
    if error is not None:
        raise ParseError(error["message"])
    return out


def load_urls(spark, urls, **options):
    """Several URLs, one after the other, as one decoded table."""
    frames = [load_url(spark, u, **options) for u in urls]
    if not frames:
        raise ValueError("no URL given")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@dataclass(frozen=True)
class ArchiveSource:
    """An archive pinned by size and checksum."""

    source_name: str
    metadata_url: str
    record_id: str
    record_version: str
    record_modified: str
    doi: str
    filename: str
    download_url: str
    media_type: str
    size_bytes: int
    sha256: str
    snapshot_date: str | None = None
    description: str = ""

    def __post_init__(self):
        check_https(self.metadata_url)
        check_https(self.download_url)
        if not self.filename.endswith(SUFFIXES) or self.size_bytes <= 0 or not re.fullmatch("[0-9a-f]{64}", self.sha256):
            raise SourceError(f"{self.source_name}: not a tar archive with a size and a SHA-256")


@dataclass(frozen=True)
class IdSnapshot:
    """A census of a live service's object ids."""

    api_url: str
    query: str
    object_type: str
    object_count: int
    identifiers_sha256: str
    first_identifier: str
    last_identifier: str

    def __post_init__(self):
        check_https(self.api_url)
        if self.object_count <= 0 or not re.fullmatch("[0-9a-f]{64}", self.identifiers_sha256) or not self.first_identifier:
            raise SourceError("an unusable census")


@dataclass(frozen=True)
class ConformanceSource:
    """Material for conformance tests, never a source of data to query."""

    source_id: str
    title: str
    organization: str
    project_url: str
    publication_doi: str
    artifact_url: str
    media_type: str
    size_bytes: int
    sha256: str
    schema_version: str
    use_case_count: int
    purpose: str
    included_by_default: bool = False
    experimental_query_eligible: bool = False

    def __post_init__(self):
        check_https(self.project_url)
        check_https(self.artifact_url)
        if self.included_by_default or self.experimental_query_eligible:
            raise SourceError("conformance material must stay apart from data")
        if self.size_bytes <= 0 or self.use_case_count <= 0 or not re.fullmatch("[0-9a-f]{64}", self.sha256):
            raise SourceError(f"{self.source_id}: sizes, counts or checksum are invalid")


KINDS = {"archives": ArchiveSource, "snapshots": IdSnapshot, "conformance": ConformanceSource}


def read_registry(path: str, kind: str) -> dict[str, object]:
    """{name: descriptor} of a registry file ``{"schema_version": 1, kind: {...}}``."""
    try:
        with open(path, encoding="utf-8") as f:
            top = json.load(f)
        if top["schema_version"] != 1:
            raise SourceError("unsupported registry version")
        cls = KINDS[kind]
        named = {ArchiveSource: "source_name", ConformanceSource: "source_id"}.get(cls)
        return {n: cls(**({named: n} if named else {}), **v) for n, v in top[kind].items()}
    except (KeyError, OSError, TypeError, ValueError) as e:
        raise SourceError(f"{path}: {e}") from e


def record(source) -> dict:
    return asdict(source)


def newest_archive(name: str, payload: dict) -> ArchiveSource:
    """The newest dated tar of a repository record's metadata."""
    found = []
    for c in payload.get("components", []):
        path = c.get("filepath", "")
        date = re.search(r"\.v(\d{4}-\d{2}-\d{2})\.", path)
        tag = c.get("checksum", {}).get("algorithm", {}).get("tag")
        if path.endswith(SUFFIXES) and date and tag == "sha256":
            found.append((date[1], path, c))
    if not found:
        raise SourceError("no dated tar archive with a SHA-256 in the record")
    date, path, c = max(found, key=lambda x: x[:2])
    return ArchiveSource(
        name, f"https://data.invalid/{quote(str(payload.get('ediid', '')))}" if "landingPage" not in payload else payload["landingPage"],
        str(payload["ediid"]), str(payload["version"]), str(payload["modified"]), str(payload.get("doi", "")), os.path.basename(path),
        c["downloadURL"], c.get("mediaType", ""), int(c["size"]), c["checksum"]["hash"].lower(), date, c.get("description", ""),
    )


def census(api_url: str, query: str, object_type: str, payload: dict) -> IdSnapshot:
    """Sorted distinct ids of a service's answer, by digest."""
    ids = payload.get("results")
    if not isinstance(ids, list) or not ids or len(set(ids)) != len(ids) or payload.get("size") != len(ids):
        raise SourceError("the answer is empty, repeats ids or misstates its size")
    ids = sorted(ids)
    digest = hashlib.sha256(("\n".join(ids) + "\n").encode()).hexdigest()
    return IdSnapshot(api_url, query, object_type, len(ids), digest, ids[0], ids[-1])


def cache_dir(variable: str = "KELVINLAKE_CACHE") -> str:
    base = os.environ.get(variable) or os.path.join(os.environ.get("XDG_CACHE_HOME") or os.path.expanduser("~/.cache"), "kelvinlake")
    return base


def digest_file(path: str) -> tuple[int, str]:
    size, h = 0, hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(1 << 20):
            size += len(chunk)
            h.update(chunk)
    return size, h.hexdigest()


def fetch_archive(source: ArchiveSource, folder: str | None = None, *, force: bool = False, timeout: float = 120, get: Get = _default_get) -> str:
    """The path of the verified archive; a file in place with its size and digest is reused."""
    folder = folder or cache_dir()
    os.makedirs(folder, exist_ok=True)
    to = os.path.join(folder, source.filename)
    pinned = (source.size_bytes, source.sha256)
    if not force and os.path.exists(to) and digest_file(to) == pinned:
        return to
    status, _, reader = get(source.download_url, timeout)
    if status >= 400:
        raise DownloadError(f"{source.download_url}: HTTP status {status}")
    with tempfile.NamedTemporaryFile(dir=folder, delete=False) as f:
        try:
            size, h = 0, hashlib.sha256()
            while chunk := reader.read(1 << 20):
                size += len(chunk)
                h.update(chunk)
                if size > source.size_bytes:
                    raise DownloadError("the download exceeds its pinned size")
                f.write(chunk)
            if (size, h.hexdigest()) != pinned:
                raise DownloadError("the download doesn't match its pinned size and digest")
            f.close()
            os.replace(f.name, to)
        finally:
            if os.path.exists(f.name):
                os.unlink(f.name)
    return to


def resolve_external(query: str, *, namespace: str = "name", timeout: float = 30, most: int = RESOLVER_BYTES, get: Get = _default_get) -> Identity:
    """One identity from the external resolver."""
    query = query.strip()
    if not query or namespace not in NAMESPACES or most <= 0:
        raise ValueError("a query, a known namespace and a positive limit are needed")
    url = f"{RESOLVER}/{namespace}/{quote(query, safe='')}/property/{RESOLVER_FIELDS}/JSON"
    try:
        status, headers, reader = get(url, timeout)
        if status == 404:
            raise ComponentNotFound(f"no {namespace} match for {query!r}")
        if status >= 400:
            raise ResolverError(f"HTTP status {status}")
        data = reader.read(most + 1)
        if len(data) > most or int({k.lower(): v for k, v in headers.items()}.get("content-length", 0)) > most:
            raise ResolverError(f"the answer exceeds {most} bytes")
        rows = json.loads(data).get("PropertyTable", {}).get("Properties")
    except (OSError, ValueError, AttributeError) as e:
        raise ResolverError(str(e)) from e
    if not rows:
        raise ComponentNotFound(f"no {namespace} match for {query!r}")
    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
        raise ResolverError("malformed records")
    merged: list[Identity] = []
    for r in rows:
        text = {k: r[k] for k in ("Title", "IUPACName", "MolecularFormula", "InChI", "InChIKey") if isinstance(r.get(k), str) and r[k].strip()}
        kinds = {"common": [query] * (namespace == "name") + [text[k] for k in ("Title",) if k in text]}
        kinds |= {k: [text[f]] for k, f in (("iupac", "IUPACName"), ("formula", "MolecularFormula"), ("inchi", "InChI"), ("inchikey", "InChIKey")) if f in text}
        if isinstance(r.get("CID"), int):
            kinds["cid"] = [str(r["CID"])]
        name = next(iter(text.values()), query)
        new = Identity(name, {k: tuple(v) for k, v in kinds.items() if v})
        same = [m for m in merged if set(m.tokens()) & set(new.tokens())] or [m for m in merged if not new.tokens() and set(m.names()) & set(new.names())]
        for m in same:
            merged.remove(m)
            both = {k: [*m.aliases.get(k, ()), *new.aliases.get(k, ())] for k in {*m.aliases, *new.aliases}}
            unique = {k: tuple({normal(x): x for x in reversed(v)}.values()) for k, v in both.items()}
            new = Identity(m.preferred_name, {k: tuple(sorted(v, key=normal)) for k, v in unique.items()})
        merged.append(new)
    if len(merged) > 1:
        raise AmbiguousComponent(f"{query!r} is ambiguous: " + ", ".join(f"{m.preferred_name} [{m.stable_identifier}]" for m in merged))
    return merged[0]


def validate_xsd(data: bytes, schema: str) -> None:
    """Against an explicit local XSD; needs the optional package."""
    from kelvinlake.errors import MissingDependency, ValidationError

    try:
        import xmlschema
    except ImportError as e:
        raise MissingDependency("XSD validation needs xmlschema") from e
    try:
        xmlschema.XMLSchema(schema).validate(data.decode())
    except Exception as e:
        raise ValidationError(f"{schema}: {e}") from e
