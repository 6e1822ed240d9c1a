"""The manifest of :mod:`paritas.llm.merkle` as one DuckDB statement."""

from __future__ import annotations

#: crc32 of a decimal number, bit by bit from the lowest.
CRC32 = """xor(list_reduce(list_prepend(4294967295, list_transform(
    range(8 * strlen({0})),
    lambda i: (ascii(substr({0}, (i // 8 + 1)::int, 1)) >> (i % 8)::int)::bigint & 1)),
    lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def _tree(name: str, nodes: str, levels: int) -> list[str]:
    """Nodes by level, and the digests beside each node."""
    parts = [f"{name}0 as (select tree, pos, n, digest from {nodes})"]
    run = "partition by tree, pos // 16 order by pos rows between"
    for k in range(levels):
        parts.append(
            f"""{name}_beside{k} as (
                select tree, pos,
                    coalesce(string_agg(digest, '') over (
                        {run} unbounded preceding and 1 preceding), '') as before,
                    coalesce(string_agg(digest, '') over (
                        {run} 1 following and unbounded following), '') as after
                from {name}{k} where n > 1)"""
        )
        parts.append(
            f"""{name}{k + 1} as (
                select tree, pos // 16 as pos, (any_value(n) + 15) // 16 as n,
                    sha256(string_agg(digest, '' order by pos)) as digest
                from {name}{k} where n > 1 group by all)"""
        )
    tops = " union all ".join(
        f"select tree, digest from {name}{k} where n = 1" for k in range(levels + 1)
    )
    parts.append(f"{name}_top as ({tops})")
    return parts


def _fold(name: str, rows: str, levels: int) -> list[str]:
    """Rows (tree, pos, folded, proof) taken up their tree."""
    parts = [f"{name}_fold0 as (select * from {rows})"]
    for k in range(levels):
        parts.append(
            f"""{name}_fold{k + 1} as (
                select f.* replace (
                    case when b.pos is null then folded
                        else sha256(before || folded || after) end as folded,
                    proof || coalesce(before || after, '') as proof)
                from {name}_fold{k} f left join {name}_beside{k} b
                    on f.tree is not distinct from b.tree and f.pos // {16**k} = b.pos)"""
        )
    return parts


def manifest_sql(levels: int = 5, upper: int = 3) -> str:
    """Good for 16^levels rows a source and 16^upper sources."""
    fields = [_field(name) for name in ("doc_id", "source", "lang", "n_chars")]
    lower = f"translate(text, '{''.join(map(chr, range(65, 91)))}', '{''.join(map(chr, range(97, 123)))}')"
    crc = CRC32.format("doc_id::varchar")
    others = " || ".join(fields)
    parts = [
        f"""leaves as (
            select doc_id, source as tree, sha256({others} || {_field("text")}) as digest,
                case when {crc} % 5 = 0 then sha256({others} || {_field(lower)})
                    else sha256({others} || {_field("text")}) end as shown
            from documents)""",
        """placed as (
            select *, row_number() over (
                    partition by tree order by doc_id nulls first, digest) - 1 as pos,
                count(*) over (partition by tree) as n
            from leaves)""",
        *_tree("low", "placed", levels),
        """sources as (
            select 0 as tree, tree as source, digest,
                row_number() over (order by tree nulls first) - 1 as pos,
                count(*) over () as n
            from low_top)""",
        *_tree("high", "sources", upper),
        "shown as (select *, shown as folded, '' as proof from placed)",
        *_fold("low", "shown", levels),
        f"""subroots as (
            select f.doc_id, f.digest as leaf, s.digest as subroot, s.tree, s.pos,
                f.folded, f.proof
            from low_fold{levels} f join sources s on f.tree is not distinct from s.source)""",
        *_fold("high", "subroots", upper),
    ]
    return f"""with {", ".join(parts)}
        select f.doc_id, f.leaf, f.subroot, r.digest as root, sha256(f.proof) as proof_sha256,
            f.folded as folded_root, f.folded = r.digest as verified
        from high_fold{upper} f cross join high_top r"""
