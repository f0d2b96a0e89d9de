"""SQL twins of the registered queries, for an engine that holds the tables as views."""

from __future__ import annotations

from shopgrain.llm.mixing import MARGINS, SEED, SWEEPS
from shopgrain.llm.quality_votes import ABSTAIN, BAD, FUNCTION_WORDS, GOOD, RULES
from shopgrain.llm.warc import BASE32, BREAKS, DIGITS, ENTITIES, HIDDEN, TAGS

WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def quality_votes(rounds: int = 12) -> str:
    """Vote counting and each round of the estimation as one step of a chain."""
    columns = [f"v_{r.name}" for r in RULES]
    votes = ", ".join(f"{r.sql()} as v_{r.name}" for r in RULES)

    def odds(step: int) -> str:
        terms = " + ".join(
            "case {c} {whens} end".format(
                c=f"x.v_{r.name}",
                whens=" ".join(f"when {v} then ln(p.g_{r.name}_{v + 1}) - ln(p.b_{r.name}_{v + 1})"
                               for v in (GOOD, BAD, ABSTAIN)),
            ) for r in RULES
        )
        return f"ln(p.share) - ln(1 - p.share) + {terms}"

    right, wrong, none = 0.8 * 2 / 3, (1 - 0.8) * 2 / 3, 1 / 3
    start = ", ".join(
        f"{good!r}::double as g_{r.name}_{v + 1}, {bad!r}::double as b_{r.name}_{v + 1}"
        for r in RULES for v, good, bad in ((GOOD, right, wrong), (BAD, wrong, right), (ABSTAIN, none, none))
    )
    steps = [f"p0 as materialized (select 0.7::double as share, {start})"]
    for k in range(rounds):
        estimates = ", ".join(
            f"(sum(case when v_{r.name} = {v} then good else 0 end) + 1) / (sum(good) + 3) as g_{r.name}_{v + 1}, "
            f"(sum(case when v_{r.name} = {v} then n - good else 0 end) + 1) / (sum(n - good) + 3) as b_{r.name}_{v + 1}"
            for r in RULES for v in (GOOD, BAD, ABSTAIN)
        )
        steps.append(
            f"p{k + 1} as materialized (select (sum(good) + 1) / (sum(n) + 2) as share, {estimates} "
            f"from (select x.*, x.n / (1 + exp(-({odds(k)}))) as good from patterns x, p{k} p))"
        )
    return rf"""
with texts as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, unnest({WORDS.format(text="text")}) as word,
  generate_subscripts({WORDS.format(text="text")}, 1) as pos from texts),
grams as (select doc_id, pos, case when lead(word, 7) over d is not null then
  word || ' ' || lead(word, 1) over d || ' ' || lead(word, 2) over d || ' ' || lead(word, 3) over d || ' ' ||
  lead(word, 4) over d || ' ' || lead(word, 5) over d || ' ' || lead(word, 6) over d || ' ' || lead(word, 7) over d end
  as gram from w window d as (partition by doc_id order by pos)),
twice as (select doc_id, pos, case when gram is not null and count(*) over (partition by doc_id, gram) > 1 then 1
  else 0 end as starts from grams),
covered as (select doc_id, max(starts) over (partition by doc_id order by pos rows between 7 preceding and current row)
  as inside from twice),
repeated as (select doc_id, sum(inside)::bigint as n_repeat_words from covered group by doc_id),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))
  as lines from texts),
counts as (select doc_id, len({WORDS.format(text="text")})::bigint as n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines,
  len(list_distinct({WORDS.format(text="text")}))::bigint as n_distinct,
  length(regexp_replace(text, '[^!]', '', 'g')) as n_exclamations,
  length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_capitals,
  len(list_filter({WORDS.format(text="text")}, lambda v: v in {FUNCTION_WORDS})) as n_function_words
  from texts join lines using (doc_id) left join repeated using (doc_id)),
votes as materialized (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, {votes} from counts),
patterns as materialized (select {", ".join(columns)}, count(*) as n from votes group by all),
{", ".join(steps)}
select x.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and 1 / (1 + exp(-({odds(rounds)}))) >= 0.5 as kept,
  {", ".join(f"v_{r.name} as vote_{r.name}" for r in RULES)}
from votes x, p{rounds} p"""


def warc_derivatives() -> str:
    def uuid(*parts: str) -> str:
        h = "sha1(concat_ws(chr(10), " + ", ".join(f"coalesce({p}::varchar, '')" for p in parts) + "))"
        return (f"'<urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-a' || "
                f"substr({h}, 18, 3) || '-' || substr({h}, 21, 12) || '>'")

    def digest(text: str) -> str:
        groups = " || ".join(
            f"to_base(('0x' || substr(sha1({text}), {5 * k + 1}, 5))::bigint, 32, 4)" for k in range(8)
        )
        return f"'sha1:' || translate({groups}, '{DIGITS}', '{BASE32}')"

    plain = "payload"
    for pattern, by in ((HIDDEN, "' '"), (BREAKS, "chr(10)"), (TAGS, "''")):
        plain = f"regexp_replace({plain}, '{pattern}', {by}, 'g')"
    for name, character in ENTITIES.items():
        if name != "amp":
            plain = f"replace({plain}, '&{name};', '{character.replace(chr(39), chr(39) * 2)}')"
    crlf = "chr(13) || chr(10)"
    return rf"""
with source as (select page_id, url, coalesce(html, '') as payload from pages),
blocks as (select *, 'HTTP/1.1 200 OK' || {crlf} || 'Content-Type: text/html; charset=utf-8' || {crlf} ||
  'Content-Length: ' || strlen(payload) || {crlf} || {crlf} || payload as block from source),
responses as (select *, {uuid("'response'", "page_id", "url", "sha1(payload)")} as refers_to,
  {digest("payload")} as payload_digest, {digest("block")} as source_digest from blocks),
named as (select *, {uuid("'metadata'", "refers_to")} as metadata_id,
  {uuid("'conversion'", "refers_to")} as conversion_id, {plain} as marked from responses),
decoded as (select *, replace(list_reduce(list_distinct(regexp_extract_all(marked, '&#([0-9]{{1,7}});', 1)),
  lambda t, n: replace(t, '&#' || n || ';', chr(n::int)), marked), '&amp;', '&') as decoded from named),
texts as (select *, trim(regexp_replace(regexp_replace(decoded, '[ \t\x0B\f\r\x{{A0}}]+', ' ', 'g'),
  ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10)) as plain from decoded),
records as (
  select page_id, metadata_id as record_id, 'metadata' as warc_type, refers_to, url as target_uri,
    'application/warc-fields' as content_type, payload_digest as source_payload_digest,
    'http-status: HTTP/1.1 200 OK' || {crlf} || 'http-header: Content-Type: text/html; charset=utf-8' || {crlf} ||
    'http-header: Content-Length: ' || strlen(payload) || {crlf} || 'source-block-digest: ' || source_digest || {crlf} ||
    'source-payload-digest: ' || payload_digest || {crlf} || 'conversion: ' || conversion_id || {crlf} as block from texts
  union all
  select page_id, conversion_id, 'conversion', refers_to, url, 'text/plain; charset=utf-8', payload_digest, plain
  from texts)
select page_id, record_id, warc_type, refers_to, target_uri, '2024-01-01T00:00:00Z' as date, content_type,
  strlen(block) as content_length, {digest("block")} as block_digest, source_payload_digest, block from records"""


PIVOT_SEARCH = """
with vectors as (select vec_id, list_transform(embedding, lambda c: floor(256 * c::double)) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
scored as (select q.vec_id as query_id, v.vec_id, list_dot_product(q.x, v.x)::bigint as score
  from vectors q join vectors v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5"""


def mixing_weights(sweeps: int = SWEEPS, power: float = 0.8) -> str:
    """Raking as a chain: one table of factors for each margin and sweep."""
    steps = []
    for margin in MARGINS:
        steps.append(
            f"share_{margin} as materialized (select {margin}, share / sum(share) over () as share from "
            f"(select {margin}, pow(sum(n_tokens)::double, {power}) as share from cells where n_tokens > 0 group by {margin}))"
        )
    last: dict[str, str] = {}
    for k in range(sweeps):
        for margin in MARGINS:
            joins = " ".join(f"join {table} using ({other})" for other, table in last.items() if other != margin)
            weight = " * ".join(["n_tokens::double", *[f"f_{o}" for o in last if o != margin]])
            steps.append(
                f"{margin}_{k} as materialized (select {margin}, share / weight as f_{margin} from (select {margin}, "
                f"sum({weight}) as weight from cells {joins} where n_tokens > 0 group by {margin}) "
                f"join share_{margin} using ({margin}))"
            )
            last[margin] = f"{margin}_{k}"
    joins = " ".join(f"left join {table} using ({margin})" for margin, table in last.items())
    weight = " * ".join(f"coalesce(f_{margin}, 1)" for margin in MARGINS)
    return rf"""
with counted as (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(text, '') as text,
  len({WORDS.format(text="coalesce(text, '')")})::bigint as n_tokens from documents),
described as (select doc_id, source, lang, n_tokens, case when n_tokens < 80 then 'short'
  when (length(text) - length(replace(text, '|', ''))) * 20 >= n_tokens then 'list'
  when length(regexp_replace(text, '[^0-9]', '', 'g')) * 50 >= length(text) then 'figures' else 'prose' end as topic
  from counted),
cells as materialized (select source, lang, topic, sum(n_tokens)::bigint as n_tokens from described group by all),
{", ".join(steps)},
weights as materialized (select source, lang, topic, {weight} as weight, n_tokens > 0 as filled from cells {joins}),
placed as (select described.*, least(weight / (select max(weight) from weights where filled), 1) as p,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':{SEED}'), 1, 13))::bigint / {16 ** 13}.0::double as place
  from described join weights using (source, lang, topic))
select doc_id, source, lang, topic, n_tokens, round(p, 9) as probability, place < p as sampled from placed"""


def merkle_manifest(levels: int = 24) -> str:
    """Each level of the trees as one step, for branches of up to ``2 ** levels`` leaves; the same tree over the roots."""
    def leaf(n_chars: str) -> str:
        fields = " || ".join(
            f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", n_chars, "text")
        )
        return f"sha256({fields})"

    def up(name: str, first: str, steps: int) -> list[str]:
        chain = [f"{name}_0 as materialized ({first})"]
        for k in range(steps):
            chain.append(
                f"{name}_{k + 1} as materialized (select branch, place // 2 as place, case when any_value(total) = 1 then "
                f"any_value(digest) else sha256(string_agg(digest, '' order by place)) end as digest, "
                f"any_value(total + 1) // 2 as total from {name}_{k} group by branch, place // 2)"
            )
        return chain

    def walk(name: str, tree: str, steps: int, first: str) -> list[str]:
        chain = [f"{name}_0 as materialized ({first})"]
        for k in range(steps):
            chain.append(
                f"{name}_{k + 1} as materialized (select w.* replace (w.place // 2 as place, w.proof || coalesce(s.digest, '') as proof, "
                f"case when n.total = 1 then w.folded when w.place % 2 = 0 then sha256(w.folded || coalesce(s.digest, '')) "
                f"else sha256(s.digest || w.folded) end as folded) from {name}_{k} w "
                f"join {tree}_{k} n on n.branch = w.branch and n.place = w.place "
                f"left join {tree}_{k} s on s.branch = w.branch and s.place = xor(w.place, 1))"
            )
        return chain

    bit = "case when d % 2 = 1 then xor(d // 2, 3988292384) else d // 2 end"
    checksum = (
        f"xor(4294967295, list_reduce([4294967295::bigint] || list_transform(string_split(doc_id::varchar, ''), lambda x: "
        f"ascii(x)::bigint), lambda c, b: list_reduce([xor(c, b)] || range(8), lambda d, k: {bit})))"
    )
    steps = [
        f"leaves as materialized (select doc_id, coalesce('=' || lang, '') as branch, {leaf('n_chars')} as leaf, "
        f"case when {checksum} % 7 = 0 then {leaf('(n_chars + 1)')} else {leaf('n_chars')} end as given from documents)",
        "placed as materialized (select *, row_number() over (partition by branch order by doc_id nulls first, leaf) - 1 as place, "
        "count(*) over (partition by branch) as total from leaves)",
        *up("tree", "select branch, place, leaf as digest, total from placed", levels),
        f"branches as materialized (select branch as name, digest, row_number() over (order by branch) - 1 as place, "
        f"count(*) over () as total from tree_{levels})",
        *up("top", "select '' as branch, place, digest, total from branches", levels),
        *walk("low", "tree", levels, "select doc_id, branch, place, leaf, given as folded, '' as proof from placed"),
        *walk("high", "top", levels, f"select l.doc_id, '' as branch, b.place, l.leaf, l.folded, l.proof, b.digest as subroot "
              f"from low_{levels} l join branches b on b.name = l.branch"),
    ]
    return f"""
with {", ".join(steps)}
select doc_id, leaf, subroot, r.digest as root, sha256(proof) as proof_sha256, folded as folded_root,
  folded = r.digest as verified from high_{levels}, top_{levels} r"""


def oracle() -> dict[str, str]:
    return {
        "op1_warc_derivatives": warc_derivatives(),
        "op2_pivot_search": PIVOT_SEARCH,
        "op4_quality_votes": quality_votes(),
        "op5_mixing_weights": mixing_weights(),
        "op13_merkle_manifest": merkle_manifest(),
    }
