"""Messages to headers, bodies, attachments, links and addresses.

Only decoding needs Python: MIME structure, transfer encodings, character sets and encoded
words go through one Arrow UDF built on the standard library. What is derived from the decoded
parts is column work.
"""

from __future__ import annotations

import email
import email.policy
import email.utils
import hashlib
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import (
    ArrayType, BooleanType, LongType, StringType, StructField, StructType,
)

from relaytrail import fixed_values as fv
from relaytrail.functions import text
from relaytrail.functions.core import blank_to_null, is_blank, map_lookup, strip, strings
from relaytrail.functions.dates import parse_mail_date
from relaytrail.functions.net import address_domain

_ADDRESS_HEADERS = ("from", "reply-to", "return-path", "to", "cc")


def _struct(**fields) -> StructType:
    return StructType([StructField(k, v) for k, v in fields.items()])


DECODED_TYPE = _struct(
    headers=ArrayType(
        _struct(
            name=StringType(), value=StringType(), is_duplicate=BooleanType(),
            is_last=BooleanType(),
        )
    ),
    texts=ArrayType(StringType()),
    htmls=ArrayType(StringType()),
    files=ArrayType(
        _struct(
            filename=StringType(), content_type=StringType(), size_bytes=LongType(),
            sha256=StringType(),
        )
    ),
    addresses=ArrayType(
        _struct(
            header=StringType(), display=StringType(), address=StringType(),
            domain_nfkc=StringType(),
        )
    ),
    defects=ArrayType(StringType()),
)
_TEXT = pa.string()
_ARROW_TYPE = pa.struct(
    [
        (
            "headers",
            pa.list_(
                pa.struct(
                    [
                        ("name", _TEXT), ("value", _TEXT), ("is_duplicate", pa.bool_()),
                        ("is_last", pa.bool_()),
                    ]
                )
            ),
        ),
        ("texts", pa.list_(_TEXT)),
        ("htmls", pa.list_(_TEXT)),
        (
            "files",
            pa.list_(
                pa.struct(
                    [
                        ("filename", _TEXT), ("content_type", _TEXT),
                        ("size_bytes", pa.int64()), ("sha256", _TEXT),
                    ]
                )
            ),
        ),
        (
            "addresses",
            pa.list_(
                pa.struct(
                    [
                        ("header", _TEXT), ("display", _TEXT), ("address", _TEXT),
                        ("domain_nfkc", _TEXT),
                    ]
                )
            ),
        ),
        ("defects", pa.list_(_TEXT)),
    ]
)


_HEADER_FACTORY = email.policy.default.header_factory
_STRUCTURED = frozenset(_HEADER_FACTORY.registry) - {"subject"}


_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
_DOT_ATOM = rf"{_ATOM}(?:\.{_ATOM})*"
_ADDRESS = rf"{_DOT_ATOM}@{_DOT_ATOM}"
_WORDS = r"[A-Za-z0-9_-]+(?: [A-Za-z0-9_-]+)*"
_PLAIN_MAILBOX = re.compile(rf'(?:(?:"({_WORDS})" |({_WORDS}) )?<({_ADDRESS})>|({_ADDRESS}))', re.ASCII)
_PLAIN_ID = re.compile(rf"<{_ADDRESS}>", re.ASCII)
_PLAIN_TYPE = re.compile(r'[A-Za-z0-9-]+/[A-Za-z0-9.+-]+(?:; [A-Za-z0-9-]+="[A-Za-z0-9._+-]+")?', re.ASCII)


def _plain_mailbox(value: str) -> tuple[str, str] | None:
    """(display name, address) of a value that is one mailbox in its plainest form."""
    found = None if "=?" in value else _PLAIN_MAILBOX.fullmatch(value)
    return found and (found[1] or found[2] or "", found[3] or found[4])


def _plain_value(name: str, value: str) -> str | None:
    """What the library makes of a structured value in its plainest form; None for all others.

    Such values (Message-IDs, senders, boundaries) differ from message to message, and the
    library's grammar takes most of the time of a message.
    """
    if name in ("from", "to", "cc", "reply-to"):
        mailbox = _plain_mailbox(value)
        return mailbox and (f"{mailbox[0]} <{mailbox[1]}>" if mailbox[0] else mailbox[1])
    plain = {"message-id": _PLAIN_ID, "content-type": _PLAIN_TYPE}.get(name)
    return value if plain is not None and "=?" not in value and plain.fullmatch(value) else None


@lru_cache(maxsize=4096)
def _structured(name: str, value: str):
    return _HEADER_FACTORY(name, value)


class _CorpusPolicy(email.policy.EmailPolicy):
    """The default policy, without parsing plain text again and again.

    The library parses a header anew on every access. Unstructured ASCII values without encoded
    words are their own text, and short structured values (content types above all) repeat
    across messages, so they are kept.
    """

    def header_fetch_parse(self, name, value):
        value = "".join(value.splitlines()) if isinstance(value, str) else value
        lowered = name.lower()
        if lowered not in _STRUCTURED and value.isascii() and "=?" not in value:
            return value
        plain = _plain_value(lowered, value)
        return _structured(name, value) if plain is None else plain


_POLICY = _CorpusPolicy()


def _printable(value) -> str:
    """Text Arrow can encode: lone surrogates of undecodable bytes become U+FFFD."""
    if value.isascii():
        return str(value)
    return str(value).encode("utf-8", "replace").decode("utf-8", "replace")


def _header_pairs(message) -> list[dict]:
    pairs, latest = [], {}
    for name, raw in message.raw_items():
        try:
            value = message.policy.header_fetch_parse(name, raw)
        except Exception:  # hostile headers can break the structured parser
            value = raw
        flat = _printable(value).replace("\r", " ").replace("\n", " ").strip()
        pair = {"name": _printable(name), "value": flat, "is_last": True}
        previous = latest.get(name.lower())
        pair["is_duplicate"] = previous is not None
        if previous is not None:
            previous["is_last"] = False
        latest[name.lower()] = pair
        pairs.append(pair)
    return pairs


def _address_rows(headers: list[dict]) -> list[dict]:
    rows, seen = [], set()
    for header in headers:
        name = header["name"].lower()
        if name not in _ADDRESS_HEADERS or name in seen:
            continue
        seen.add(name)
        plain = _plain_mailbox(header["value"])
        try:
            pairs = email.utils.getaddresses([header["value"]]) if plain is None else [plain]
        except Exception:
            pairs = []
        for display, address in pairs:
            if address:
                address = address.strip().lower()
                domain = address.rsplit("@", 1)[1] if "@" in address else None
                rows.append(
                    {
                        "header": name,
                        "display": display.strip(),
                        "address": address,
                        "domain_nfkc": domain and unicodedata.normalize("NFKC", domain),
                    }
                )
    return rows


def _leaves(message):
    """All leaf parts in document order; the stack is the walk's own, so depth has no bound."""
    stack = [message]
    while stack:
        part = stack.pop()
        if part.is_multipart():
            stack.extend(reversed(list(part.iter_parts())))
        else:
            yield part


def _decode_one(raw: bytes) -> dict:
    message = email.message_from_bytes(raw, policy=_POLICY)
    defects = [type(d).__name__ for d in message.defects]
    headers = _header_pairs(message)
    texts, htmls, files = [], [], []
    for part in _leaves(message):
        try:
            kind = (part.get_content_type() or "application/octet-stream").lower()
            disposition = (part.get_content_disposition() or "").lower()
            filename = part.get_filename()
            payload = part.get_payload(decode=True)
        except Exception as exc:
            defects.append(f"undecodable_part:{type(exc).__name__}")
            continue
        if payload is None:
            continue
        target = {"text/plain": texts, "text/html": htmls}.get(kind)
        if target is not None and disposition != "attachment" and not filename:
            try:
                target.append(payload.decode(part.get_content_charset() or "utf-8", "replace"))
            except (LookupError, ValueError):
                target.append(payload.decode("utf-8", "replace"))
        else:
            files.append(
                {
                    "filename": None if filename is None else _printable(filename),
                    "content_type": _printable(kind),
                    "size_bytes": len(payload),
                    "sha256": hashlib.sha256(payload).hexdigest(),
                }
            )
    return {
        "headers": headers,
        "texts": [_printable(t) for t in texts],
        "htmls": [_printable(t) for t in htmls],
        "files": files,
        "addresses": _address_rows(headers),
        "defects": sorted(set(defects)),
    }


#: Bytes of messages that are Python objects at a time, of a batch that may hold very large ones.
PIECE_BYTES = 1 << 20


def _decoded_pieces(content: pa.Array):
    rows, held = [], 0
    for value in content:
        raw = value.as_py()
        rows.append(None if raw is None else _decode_one(raw))
        held += len(raw or b"")
        if held >= PIECE_BYTES:
            yield pa.array(rows, type=_ARROW_TYPE)
            rows, held = [], 0
    yield pa.array(rows, type=_ARROW_TYPE)


def _decode_batch(content: pa.Array) -> pa.Array:
    return pa.concat_arrays(list(_decoded_pieces(content)))


_decode_batch.__annotations__ = {"content": pa.Array, "return": pa.Array}
decode_message = F.arrow_udf(_decode_batch, DECODED_TYPE)


def describe_attachments(files: Column) -> Column:
    """Add ``is_archive`` and ``extension_mismatch`` to decoded files."""

    def describe(f: Column) -> Column:
        name = F.lower(F.coalesce(f["filename"], F.lit("")))
        archive = f["content_type"].isin(*fv.ARCHIVE_TYPES) | F.exists(
            strings(fv.ARCHIVE_EXTENSIONS), lambda e: name.endswith(e)
        )
        extension = F.when(
            name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))
        )
        expected = map_lookup(fv.EXTENSION_TYPES, F.coalesce(extension, F.lit("")))
        return F.struct(
            f["filename"].alias("filename"),
            f["content_type"].alias("content_type"),
            f["size_bytes"].alias("size_bytes"),
            f["sha256"].alias("sha256"),
            archive.alias("is_archive"),
            F.coalesce(expected != f["content_type"], F.lit(False)).alias("extension_mismatch"),
        )

    return F.transform(files, describe)


def _first_address(header: str, field: str) -> Column:
    rows = F.filter("addresses", lambda a: a["header"] == header)
    return F.get(rows, 0)[field]


def parse_messages(messages: DataFrame, content: str = "content") -> DataFrame:
    """One row per message in, one row per message out; ``content`` is dropped."""
    decoded = messages.withColumn("_decoded", decode_message(F.col(content))).drop(content)
    carried = [c for c in decoded.columns if c != "_decoded"]
    parts = decoded.select(
        *carried,
        F.col("_decoded.headers").alias("headers"),
        F.array_join("_decoded.texts", "\n").alias("_plain"),
        F.array_join("_decoded.htmls", "\n").alias("html_body"),
        describe_attachments(F.col("_decoded.files")).alias("attachments"),
        F.col("_decoded.addresses").alias("addresses"),
        F.col("_decoded.defects").alias("defects"),
    )
    no_plain = is_blank(F.col("_plain")) & (F.col("html_body") != "")
    bodied = parts.withColumn(
        "text_body",
        F.when(no_plain, text.html_to_text(F.col("html_body"))).otherwise(F.col("_plain")),
    ).drop("_plain")
    return bodied.select(
        "*",
        (~is_blank(F.col("html_body"))).alias("html_present"),
        text.extract_urls(F.col("text_body"), F.col("html_body")).alias("urls"),
        blank_to_null(strip(text.header_value(F.col("headers"), "Subject"))).alias("subject"),
        parse_mail_date(text.header_value(F.col("headers"), "Date")).alias("sent_at"),
        text.header_value(F.col("headers"), "Message-ID").alias("message_id"),
        _first_address("from", "display").alias("from_display"),
        _first_address("from", "address").alias("from_address"),
        address_domain(_first_address("from", "address")).alias("from_domain"),
        _first_address("from", "domain_nfkc").alias("from_domain_nfkc"),
        _first_address("reply-to", "address").alias("reply_to_address"),
        address_domain(_first_address("reply-to", "address")).alias("reply_to_domain"),
        _first_address("return-path", "address").alias("return_path"),
        F.when(F.size("defects") > 0, "malformed").otherwise("parsed").alias("parse_status"),
    )


def header_rows(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per header occurrence in emission order."""
    return parsed.select(*keys, F.posexplode("headers").alias("ordinal", "h")).select(
        *keys,
        "ordinal",
        F.col("h.name").alias("name"),
        F.col("h.value").alias("value_raw"),
        F.col("h.is_duplicate").alias("is_duplicate"),
    )


def header_map(headers: Column) -> Column:
    """Lower-cased name to value; the last occurrence wins."""
    kept = F.filter(headers, lambda h: h["is_last"])
    return F.map_from_entries(
        F.transform(kept, lambda h: F.struct(F.lower(h["name"]), h["value"]))
    )
