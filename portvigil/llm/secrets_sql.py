"""DuckDB SQL for the secret scan, with the patterns and limits of ``secrets``."""

from __future__ import annotations

from portvigil.llm import secrets as S


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _spans(name: str, pattern: str, table: str = "texts") -> str:
    """A table of (row, start, end, match): places are sums over the texts between the matches."""
    p = _text(pattern)
    return f"""
        {name}_found as (
            select row_id, regexp_extract_all(text, {p}) as m, regexp_split_to_array(text, {p}) as b from {table}
            where regexp_matches(text, {p})
        ),
        {name}_steps as (
            select row_id, unnest(range(1, len(m) + 1)) as i, m, b from {name}_found
        ),
        {name} as (
            select row_id, match, finish - length(match) as start, finish from (
                select row_id, m[i] as match,
                       sum(length(b[i]) + length(m[i])) over (partition by row_id order by i) as finish
                from {name}_steps
            ) s
        )"""


def scan_sql() -> str:
    kind = {k: i for i, k in enumerate(S.KINDS)}
    (id_low, id_high), (secret_low, secret_high) = S.IDENTIFIER_LENGTH, S.SECRET_LENGTH
    roles = "case kind " + " ".join(f"when {kind[k]} then '{r}'" for k, r in S.ROLES.items()) + " end"
    names = "case kind " + " ".join(f"when {kind[k]} then '{k}'" for k in S.KINDS) + " end"
    listed = f"string_agg({names} || ':' || start || ':' || finish, ',' order by start, kind)"
    return f"""
        with texts as (
            select row_number() over () as row_id, doc_id, coalesce(text, '') as text from documents
        ),
        {_spans("assign", S.ASSIGN)}, {_spans("access", S.ACCESS)}, {_spans("hex", S.HEX)},
        {_spans("token", S.TOKEN)}, {_spans("endpoint", S.ENDPOINT)},
        strong as (
            select row_id, {kind["assign"]} as kind, start, finish from assign
            where length(regexp_extract(match, {_text(S.ASSIGN)}, 2)) >= {S.ASSIGN_VALUE}
            union all select row_id, {kind["access"]}, start, finish from access
            union all select row_id, {kind["hex"]}, start, finish from hex
        ),
        loose as (
            select row_id, {kind["id"]} as kind, start, finish from token
            where regexp_matches(match, '^[A-Z0-9]{{{id_low},{id_high}}}$') and regexp_matches(match, '[A-Z]') and regexp_matches(match, '[0-9]')
            union all select row_id, {kind["secret"]}, start, finish from token
            where length(match) between {secret_low} and {secret_high} and regexp_matches(match, '[A-Z]')
              and regexp_matches(match, '[a-z]') and regexp_matches(match, '[0-9]')
            union all select row_id, {kind["endpoint"]}, start, finish from endpoint
        ),
        weak as (
            select * from loose w where not exists (
                select 1 from strong s where s.row_id = w.row_id and w.start < s.finish and s.start < w.finish)
        ),
        parts as (
            select *, {roles} as role from (select * from strong union all select * from weak) a
        ),
        linked as (
            select row_id, kind, start, finish from parts w where kind >= {kind["id"]} and exists (
                select 1 from parts p where p.row_id = w.row_id and (p.role = 'secret') <> (w.role = 'secret')
                  and w.start - p.finish <= {S.SCOPE} and p.start - w.finish <= {S.SCOPE})
        ),
        base as (
            select row_id, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access,
                   count(*) filter (where kind = 2) as n_hex, {listed} as listed
            from strong group by row_id
        ),
        everything as (
            select row_id, {listed} as listed from (select * from strong union all select * from linked) a group by row_id
        )
        select t.doc_id, coalesce(b.n_assign, 0) as n_assign, coalesce(b.n_access, 0) as n_access,
               coalesce(b.n_hex, 0) as n_hex, sha256(coalesce(b.listed, '')) as base_sha256,
               coalesce(e.listed, '') as spans
        from texts t left join base b using (row_id) left join everything e using (row_id)
    """
