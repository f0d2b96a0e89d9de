"""Derivatives of archived HTTP responses.

Each response record gives two records that name it in ``WARC-Refers-To``: a metadata record, whose
``application/warc-fields`` block holds the status line, the source's HTTP headers, its digests and the id of the
conversion, and a conversion record, whose ``text/plain`` block is the text of the HTML payload. Identifiers follow
from the source's identifier, so a repeated run or a retried task names the same records. One narrow pass; nothing is
shuffled.

* A null block counts as empty; a block without a blank line is all headers and has an empty payload. A null target
  URI or date stays null and its header line is left out. Empty texts give a conversion of length 0.
* Repeated response rows give repeated derivatives. An empty table gives an empty result. Blocks of any length are converted
  whole. Columns of the source that have the name of a result's column are replaced; others are carried.
* Plain text: comments, scripts, styles and tags go, block-level tags end a line, character references of
  ``ENTITIES`` and numeric ones are decoded once, white space inside a line becomes one space, empty lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopgrain.llm.common import bound, computed

CRLF = "\r\n"
# Character references, the ampersand last.
ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "copy": "©", "reg": "®", "trade": "™",
    "middot": "·", "bull": "•", "hellip": "…", "mdash": "—", "ndash": "–", "lsquo": "‘", "rsquo": "’", "ldquo": "“",
    "rdquo": "”", "laquo": "«", "raquo": "»", "euro": "€", "pound": "£", "sect": "§", "deg": "°", "times": "×",
    "amp": "&",
}
# Elements that end a line.
BLOCK_TAGS = (
    "a(?:ddress|rticle|side)|b(?:lockquote|ody|r)|d(?:d|iv|l|t)|f(?:ieldset|igcaption|igure|ooter|orm)|"
    "h(?:[1-6]|ead|eader|r|tml)|li|main|nav|o(?:l|ption)|p(?:re)?|section|t(?:able|d|h|itle|r)|ul"
)
HIDDEN = r"(?is)<(?:!--.*?-->|script\b.*?</script[^>]*>|style\b.*?</style[^>]*>)"
BREAKS = rf"(?i)</?(?:{BLOCK_TAGS})\b[^>]*>"
TAGS = r"<[a-zA-Z/!?][^>]*>"
# Digits of base 32 as Spark writes them, and as digests are written.
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexadecimal: Column) -> Column:
    """Of 40 hexadecimal digits: five of them are four digits of base 32."""
    groups = [F.lpad(F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def record_id(*parts: Column) -> Column:
    """A name-based identifier of the parts; nulls count as empty."""
    h = F.sha1(F.concat_ws("\n", *[F.coalesce(part.cast("string"), F.lit("")) for part in parts]))
    pieces = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
              F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def plain_text(html: Column) -> Column:
    text = F.regexp_replace(html, HIDDEN, " ")
    text = F.regexp_replace(text, BREAKS, "\n")
    text = F.regexp_replace(text, TAGS, "")
    text = bound(text, with_names)
    text = bound(text, with_numbers)
    text = F.replace(text, F.lit("&amp;"), F.lit("&"))
    text = F.regexp_replace(text, r"[ \t\x0B\f\r\xA0]{2,}|[\t\x0B\f\r\xA0]", " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return F.btrim(text, F.lit(" \n"))


def with_names(text: Column) -> Column:
    """Named character references replaced but for the ampersand's, each name that occurs once."""
    known = F.create_map(*[F.lit(x) for pair in ENTITIES.items() if pair[0] != "amp" for x in pair])
    names = F.array_distinct(F.regexp_extract_all(text, F.lit("&([a-z]+);"), F.lit(1)))
    names = F.filter(names, lambda n: F.map_contains_key(known, n))
    replaced = F.aggregate(names, text, lambda t, n: F.replace(t, F.concat(F.lit("&"), n, F.lit(";")), F.element_at(known, n)))
    return F.when(F.contains(text, F.lit("&")), replaced).otherwise(text)


def with_numbers(text: Column) -> Column:
    """Decimal character references replaced, each number once."""
    numbers = F.array_distinct(F.regexp_extract_all(text, F.lit("&#([0-9]{1,7});"), F.lit(1)))
    replaced = F.aggregate(numbers, text, lambda t, n: F.replace(t, F.concat(F.lit("&#"), n, F.lit(";")), code_point(n)))
    return F.when(F.contains(text, F.lit("&#")), replaced).otherwise(text)


def code_point(digits: Column) -> Column:
    """The character of a decimal number; numbers that name none give U+FFFD."""
    number = digits.cast("int")
    valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
    utf32 = F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0"))
    return F.decode(utf32, "UTF-32")


def responses_of_pages(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of fetched pages: record_id, target_uri, date, block and its digests."""
    payload = F.coalesce("html", F.lit(""))
    block = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(payload).cast("string"), F.lit(CRLF + CRLF), payload,
    )
    df = pages.select("page_id", "url", F.lit(date).alias("date"), payload.alias("payload"), block.alias("block"))
    df = computed(df, block_hash=F.sha1("block"), payload_hash=F.sha1("payload"))
    return df.select(
        "page_id",
        record_id(F.lit("response"), F.col("page_id"), F.col("url"), F.col("payload_hash")).alias("record_id"),
        F.col("url").alias("target_uri"), "date", "block",
        F.concat(F.lit("sha1:"), base32(F.col("block_hash"))).alias("block_digest"),
        F.concat(F.lit("sha1:"), base32(F.col("payload_hash"))).alias("payload_digest"),
    )


def derive(responses: DataFrame) -> DataFrame:
    """A metadata and a conversion record for every response record; other columns are carried along."""
    own = ["record_id", "target_uri", "date", "block", "block_digest", "payload_digest"]
    carried = [name for name in responses.columns if name not in own]
    df = responses.select(F.struct(*carried, F.lit(0).alias("_")).alias("carried"), *own[:3],
                          F.coalesce("block", F.lit("")).alias("block"), *own[4:])
    cut = F.instr("block", CRLF + CRLF)
    df = computed(
        df,
        head=F.when(cut > 0, F.substr("block", F.lit(1), cut - 1)).otherwise(F.col("block")),
        text=plain_text(F.when(cut > 0, F.substr("block", cut + 4)).otherwise(F.lit(""))),
        metadata_id=record_id(F.lit("metadata"), F.col("record_id")),
        conversion_id=record_id(F.lit("conversion"), F.col("record_id")),
    )
    lines = F.split("head", CRLF)
    fields = F.concat(
        F.lit("http-status: "), F.get(lines, F.lit(0)), F.lit(CRLF),
        F.array_join(F.transform(F.slice(lines, 2, F.size(lines)), lambda x: F.concat(F.lit("http-header: "), x, F.lit(CRLF))), ""),
        F.lit("source-block-digest: "), F.coalesce("block_digest", F.lit("")), F.lit(CRLF),
        F.lit("source-payload-digest: "), F.coalesce("payload_digest", F.lit("")), F.lit(CRLF),
        F.lit("conversion: "), F.col("conversion_id"), F.lit(CRLF),
    )

    def record(identifier: str, kind: str, content_type: str, block: Column) -> Column:
        return F.struct(
            F.col(identifier).alias("record_id"), F.lit(kind).alias("warc_type"), F.lit(content_type).alias("content_type"),
            block.alias("block"),
        )

    pair = F.array(
        record("metadata_id", "metadata", "application/warc-fields", fields),
        record("conversion_id", "conversion", "text/plain; charset=utf-8", F.col("text")),
    )
    df = df.select("carried", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.inline(pair))
    df = df.withColumnRenamed("payload_digest", "source_payload_digest")
    df = computed(df, block_hash=F.sha1("block"))
    return df.select(
        *[F.col("carried").getField(name).alias(name) for name in carried],
        "record_id", "warc_type", "refers_to", "target_uri", "date", "content_type",
        F.octet_length("block").cast("long").alias("content_length"),
        F.concat(F.lit("sha1:"), base32(F.col("block_hash"))).alias("block_digest"),
        "source_payload_digest", "block",
    )


def serialized(records: DataFrame) -> DataFrame:
    """The records as they stand in an archive file: header lines, blank line, block, two line ends."""

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))

    return records.select(F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length")),
        F.lit(CRLF), F.col("block"), F.lit(CRLF + CRLF),
    ).alias("record"))


def write_archive(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """One archive file per partition. The writer ends each row itself, so the last line feed is left to it."""
    rows = serialized(records).select(F.expr("substr(record, 1, length(record) - 1)").alias("record"))
    rows.write.option("lineSep", "\n").option("compression", compression).text(path)
