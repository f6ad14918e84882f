"""Secret scan with corpus-wide ownership frequency.

Candidates are found by patterns in each whole text.  Their values' hashes are then counted over the corpus by distinct
repositories and owners: a value under several owners is a widely copied example, one that stays with an owner and looks
random is taken for a live credential.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyard.llm.shared import kept, raw, text_slices

#: The kinds in their order, each with its pattern, the group that is the value, and the value's least length.
KINDS: list[tuple[str, str, int, int, int]] = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", re.ASCII, 0, 20),
    ("hex", r"[0-9a-f]{24,}", re.ASCII, 0, 24),  # a maximal run, as with + and the length checked after
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", re.ASCII, 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", re.ASCII, 0, 40),
    ("github", r"gh[pousr]_[A-Za-z0-9]+", re.ASCII, 0, 40),
]
N_BASE = 3
_PATTERNS = [(re.compile(p, flags), group, least) for _, p, flags, group, least in KINDS]
_LOWER, _EXACT = [b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey"], [b"AKIA", b"-----BEGIN ", b"eyJ", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_"]
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
#: A private key's body: up to its END line, or else the lines of base64 (with the headers of old key files before them) after
#: the BEGIN line, whether broken by line feeds, by escapes or by quotes; and the characters by which it is known.
_PEM, _PEM_END = 3, re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
_GAP = r"(?: \+|\\[nrt]|[\s\"',>#*|])"
_PEM_LINES = re.compile(rf"(?:{_GAP}*+(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:{_GAP}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++(?:(?:\r?\n|\\n)[\x20\t]*+[A-Za-z0-9+/]{{1,15}}+={{0,2}}+(?=[\x20\t]*+(?:\r?\n|\\n|[\"']|\Z)))?")
_PEM_LEAST, _NOT_KEY = 16, re.compile(rf"(?:Proc-Type|DEK-Info):[^\n\\]*+|\\[nrt]|[^A-Za-z0-9+/=]| \+")
_EDGE = re.compile(rf"{_GAP}*+")
#: Owners from which on a value is a widely copied example.
COPIED_OWNERS = 3
#: Distinct characters from which on the SQL takes a value to look live; here placeholders are told by what they are.
LIVE_CHARACTERS = 9
#: Distinct characters that a value needs for each of its own, and at most.
LEAST_DISTINCT, MOST_DISTINCT = 0.4, 6
#: Share of steps to the same or the next character, up or down, from which on a value is a run or a sequence.
RUN = 0.7
_PLAIN_WORDS = set(
    "password passwd passphrase pass secret secrets token tokens apikey api key keys example sample placeholder changeme change me your my here test testing dummy default "
    "none null nil true false undefined unknown todo tbd foo bar baz foobar qwerty asdfgh letmein welcome admin root user username value string insert replace redacted removed "
    "hidden masked empty fake demo env config process self this request response required optional access auth bearer the a an is not with for".split()
)
#: JSON web tokens are looked for in chains of three runs and more joined by dots, so that no place is gone over again and again.
_JWT, _JWT_HEAD = 4, "eyJ"
_CHAIN, _RUN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++){2,}+"), re.compile(r"[A-Za-z0-9_-]++")
#: Bits of the filter that keeps rows without a live value from moving; a fuller filter only moves more rows.
MASK_BITS = 1 << 25
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
MASK = "[secret]"


def _key_body(text: str, at: int, before: int) -> tuple[int, int] | None:
    """Where the body of the private key stands whose BEGIN line ends at ``at``; the next one begins at ``before``."""
    end = _PEM_END.search(text, at, before)
    lines = None if end else _PEM_LINES.match(text, at, before)
    stop = end.start() if end else lines.end() if lines else at
    start = min(_EDGE.match(text, at, stop).end(), stop)
    while start < stop and text[stop - 1] in " \t\r\n\"',>#*|":
        stop -= 1
    while stop - start > 1 and text[stop - 2 : stop] in ("\\n", "\\r", "\\t"):
        stop -= 2
    return (start, stop) if len(_NOT_KEY.sub("", text[start:stop])) >= _PEM_LEAST else None


def _web_tokens(text: str) -> list[tuple[int, int]]:
    """The matches of the jwt pattern, in one pass: of three runs joined by dots, from the first one's first ``eyJ`` on."""
    out = []
    if _JWT_HEAD not in text:
        return out
    for chain in _CHAIN.finditer(text):
        runs = [m.span() for m in _RUN.finditer(text, *chain.span())]
        k = 0
        while k + 2 < len(runs):
            at = text.find(_JWT_HEAD, runs[k][0], runs[k][1] - 1)  # a character must follow it
            if at >= 0:
                out.append((at, runs[k + 2][1]))
            k += 3 if at >= 0 else 1
    return out


def find(text: str) -> list[tuple[int, int, int, int, int]]:
    """Candidates by start, then kind: start, end, kind, and where the value stands (code points).  A private key is named by its
    BEGIN line, its value is the body; a line without a body is its own value."""
    out = []
    for kind, (pattern, group, least) in enumerate(_PATTERNS):
        if kind == _PEM:
            heads = [m.span() for m in pattern.finditer(text)]
            nexts = [*(a for a, _ in heads[1:]), len(text)][: len(heads)]
            out += [(a, b, kind, *(_key_body(text, b, end) or (a, b))) for (a, b), end in zip(heads, nexts, strict=True)]
            continue
        if kind == _JWT:
            out += [(a, b, kind, a, b) for a, b in _web_tokens(text) if b - a >= least]
            continue
        out += [(*m.span(), kind, *m.span(group)) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(out, key=lambda x: (x[0], x[2]))


def _suspects(texts: pa.StringArray) -> np.ndarray:
    """Texts that can hold a candidate; the rest surely hold none."""
    data, begins = raw(texts)
    at = []
    whole = data.tobytes()
    for words, inside in ((_LOWER, whole.lower()), (_EXACT, whole)):
        for word in words:
            k = inside.find(word)
            while k >= 0:
                at.append(k)
                k = inside.find(word, k + 1)
    inside, first = _HEX[data], np.zeros(len(data) + 1, bool)
    first[begins] = True  # a run ends where its text ends
    start, stop = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    stop[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(start)
    runs = starts[np.flatnonzero(stop) - starts >= 23]
    out = np.zeros(len(texts), bool)
    out[np.searchsorted(begins, np.concatenate([np.array(at, np.int64), runs]), side="right") - 1] = True
    return out


def _named(text: str, a: int, b: int, kind: int) -> bytes:
    """What a value is known by over the corpus: a key's body is the same however its lines are broken."""
    value = text[a:b]
    return (_NOT_KEY.sub("", value) if kind == _PEM and not value.startswith("-----BEGIN ") else value).encode()


def looks_live(value: str) -> bool:
    """Whether a value is no placeholder: not of few characters for its length, a run, a sequence, a repeated piece or common words."""
    if value.startswith("-----BEGIN "):
        return len(set(value)) >= LIVE_CHARACTERS
    low = value.lower()
    n = len(low)
    if len(set(low)) < min(MOST_DISTINCT, LEAST_DISTINCT * n):
        return False
    steps = [ord(y) - ord(x) for x, y in zip(low, low[1:], strict=False)]
    if any(sum(d in (0, by) for d in steps) >= RUN * len(steps) for by in (1, -1)):
        return False
    if (low + low).find(low, 1) < n:
        return False
    words = [w.lower() for w in _WORD.findall(value)]
    return not (words and (low.strip("._-=/+") in _PLAIN_WORDS or all(w in _PLAIN_WORDS for w in words)) and sum(c.isdigit() for c in low) <= 4)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    value = pa.struct([("hash", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("live", pa.bool_())])
    for batch, texts in text_slices(batches):
        n = len(texts)
        found: list[list] = [[] for _ in range(n)]
        values: list[list] = [[] for _ in range(n)]
        for k in np.flatnonzero(_suspects(texts)).tolist():
            text = texts[k].as_py()
            found[k] = find(text)
            places = {x[3:]: x[2] for x in found[k]}
            values[k] = [{"hash": hashlib.sha256(_named(text, a, b, kind)).hexdigest(), "start": a, "stop": b, "live": looks_live(text[a:b])} for (a, b), kind in sorted(places.items())]
        spans = [[f"{KINDS[x[2]][0]}:{x[0]}:{x[1]}" for x in own] for own in found]
        base = [",".join(s for s, x in zip(ss, own, strict=True) if x[2] < N_BASE) for ss, own in zip(spans, found, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                *(batch.column(c) for c in ("doc_id", "text_hash", "repository", "owner")),
                *(pa.array([sum(x[2] == kind for x in own) for own in found], pa.int64()) for kind in range(N_BASE)),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base]),
                pa.array([",".join(x) for x in spans]),
                pa.array(values, pa.list_(value)),
            ],
            names=["doc_id", "text_hash", "repository", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"],
        )


_SCHEMA = "doc_id long, text_hash long, repository string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<struct<hash:string,start:long,stop:long,live:boolean>>"


def scan(docs: DataFrame, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """Candidates per row, as a table in the shared folder.  The table ``documents`` names its owner by source; each of the
    source's languages is a repository.  Null columns count as empty strings, null text as empty text."""
    owner = F.coalesce(F.col("source").cast("string"), F.lit("")) if owner is None else owner
    repository = F.concat_ws("/", owner, F.coalesce(F.col("lang").cast("string"), F.lit(""))) if repository is None else repository
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), repository.alias("repository"), owner.alias("owner"), text.alias("text"))
    return kept(base.mapInArrow(_scan, _SCHEMA).withColumn("row_id", F.monotonically_increasing_id()), "secrets")


def ownership(scanned: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Per value hash: n_repositories, n_owners, n_documents, copied.  Distinct (value, repository, owner) first, so that a value
    in a third of all rows leaves each task as a few counts."""
    each = scanned.select("repository", "owner", F.explode("found.hash").alias("hash"))
    per = each.groupBy("hash", "repository", "owner").agg(F.count("*").alias("n"))
    return per.groupBy("hash").agg(F.count_distinct("repository").alias("n_repositories"), F.count_distinct("owner").alias("n_owners"), F.sum("n").alias("n_candidates")).withColumn("copied", F.col("n_owners") >= copied_owners)


def secrets(docs: DataFrame, copied_owners: int = COPIED_OWNERS, repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_copied, n_live, max_owners.

    Spans are kind:start:end of whole matches in code points, end exclusive, by start, then kind; a match whose value is too
    short is dropped after it has been passed over.  n_copied counts the row's distinct value places with widely copied
    values, n_live those of other values that look random, max_owners is the most owners any of its values has (0 without
    any).  Null and empty texts have no spans; repeated rows each get a row and count once for each owner.
    """
    scanned = scan(docs, repository, owner)
    each = scanned.select("row_id", F.explode("found").alias("v")).select("row_id", "v.hash", "v.live")
    judged = each.join(kept(ownership(scanned, copied_owners), "secrets-owners"), "hash")  # a table, so that the join can split a hash that many rows hold
    per = judged.groupBy("row_id").agg(F.count_if("copied").alias("n_copied"), F.count_if(~F.col("copied") & F.col("live")).alias("n_live"), F.max("n_owners").alias("max_owners"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_copied", "n_live", "max_owners")]
    return scanned.join(per, "row_id", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", *zero)


def mask_live(docs: DataFrame, copied_owners: int = COPIED_OWNERS, mask: str = MASK, bits: int = MASK_BITS) -> DataFrame:
    """``docs`` with the values of live-looking secrets replaced by ``mask``; rows and columns stay as they are.

    Rows are told apart by doc_id and text (repeated rows are masked alike; null text has nothing to mask).  A bitmap of
    ``bits`` bits over the hashes of rows with a live value, whose size is fixed, is sent to the tasks; rows outside it are
    passed through where they are, the few others are joined with their places.
    """
    columns, scanned = docs.columns, scan(docs)
    each = scanned.select("doc_id", "text_hash", F.explode("found").alias("v")).where("v.live")
    single = kept(ownership(scanned, copied_owners).where("not copied").select(F.col("hash").alias("own")), "secrets-owners")
    live = each.join(single, F.col("v.hash") == F.col("own"))
    places = kept(live.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("v.start", "v.stop")).alias("places")).select(_slot(F.col("doc_id"), F.col("text_hash"), bits).alias("slot"), F.col("doc_id").alias("mask_doc"), F.col("text_hash").alias("mask_hash"), "places"), "secrets-live")
    slot, bucket, held, maybe, own_hash, own_places, mask_doc, mask_hash = (_free(columns, n) for n in ("slot", "bucket", "held", "maybe", "hash", "places", "mask_doc", "mask_hash"))
    text_hash = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    rows = docs.withColumns({own_hash: text_hash, slot: _slot(docs["doc_id"].cast("long"), text_hash, bits)})
    bitmap = F.broadcast(_bitmap(places)).withColumnsRenamed({"bucket": bucket, "bitmap": held})
    marked = rows.join(bitmap, F.expr(f"bitmap_bucket_number({slot})") == F.col(bucket), "left")
    byte = F.conv(F.hex(F.expr(f"substring({held}, cast(bitmap_bit_position({slot}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    marked = marked.withColumn(maybe, F.coalesce(byte.bitwiseAND(F.expr(f"shiftleft(1, cast(bitmap_bit_position({slot}) % 8 as int))")) > 0, F.lit(False)))
    passed = marked.where(f"not {maybe}").select(*(F.col(f"`{c}`") for c in columns))
    few = marked.where(maybe).select(*(F.col(f"`{c}`") for c in columns), own_hash)
    whose = places.select(F.col("mask_doc").alias(mask_doc), F.col("mask_hash").alias(mask_hash), F.col("places").alias(own_places))
    found = few.join(whose, F.col("doc_id").cast("long").eqNullSafe(F.col(mask_doc)) & (F.col(own_hash) == F.col(mask_hash)), "left").select(*(F.col(f"`{c}`") for c in columns), own_places)

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index("text")
        for whole in batches:
            for batch, _ in text_slices(iter([whole])):
                texts = [_mask(t, p, mask) for t, p in zip(batch.column(at).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)]
                arrays = batch.columns[: len(columns)]
                yield pa.RecordBatch.from_arrays([*arrays[:at], pa.array(texts, batch.column(at).type), *arrays[at + 1 :]], names=columns)

    return passed.unionByName(found.mapInArrow(masked, docs.schema))


def _free(columns: list[str], name: str) -> str:
    """A column's name that the table does not have."""
    while name.lower() in {c.lower() for c in columns}:
        name = f"_{name}"
    return name


def _slot(doc_id: Column, text_hash: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, text_hash), F.lit(bits))


def _bitmap(places: DataFrame) -> DataFrame:
    """bucket, bitmap: the places' slots as bits; a row of 4 KB for every 32768 of them at most."""
    return places.groupBy(F.expr("bitmap_bucket_number(slot)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("bitmap"))


def _mask(text: str, places, mask: str) -> str:
    if text is None or places is None:
        return text
    out, end = [], 0
    for p in sorted(places, key=lambda x: (x["start"], -x["stop"])):
        if p["stop"] > end:
            if p["start"] >= end:
                out += [text[end : p["start"]], mask]
            end = p["stop"]
    return "".join([*out, text[end:]])
