"""SQL of the same stages for DuckDB: named parts, put together with what they need."""

from __future__ import annotations

import re

from strandfold.params import DOCUMENTS as P

_SPLIT = "list_filter(list_transform(string_split_regex(text, '[.!?\\n]+'), lambda x: trim(x, ' ')), lambda x: length(x) >= 10)"
_BANDS = ", ".join(f"b{k}" for k in range(8))
_FLAT = "(b0 = 0 and b1 = 0 and b2 = 0 and b3 = 0 and ((b4 = 0 and b5 = 0 and b6 = 0 and b7 = 0) or (b4 = 65535 and b5 = 65535 and b6 = 65535 and b7 = 65535)))"
_VOTES = ", ".join(
    "(" + " + ".join(f"case when 2 * sum((v{k} >> {i}) & 1) > count(*) then {1 << i} else 0 end" for i in range(16)) + f")::int as b{k}" for k in range(8)
)
_TOKENS = "[" + ", ".join(f"b{k} + {k << 16}" for k in range(8)) + "]"
_DISTANCE = " + ".join(f"bit_count(xor(x.b{k}, y.b{k}))" for k in range(8)) + " + least(8, abs(x.mean - y.mean) // 16)"
_2_64 = "18446744073709551616::uhugeint"
_CLOSURE = "select {a} as a, {b} as b from {edges} union select {b}, {a} from {edges}"
_NONE = "[]::struct(\"start\" int, \"end\" int)[]"


def _normal(bins: str, n: str) -> str:
    """Sorted list of bins, normalised."""
    return (
        f"list_sort(list_distinct(list_concat({bins}, list_transform(list_filter({bins}, lambda x: list_contains({bins}, x + 2) and not list_contains({bins}, x + 1)), lambda x: x + 1), "
        f"case when list_min({bins}) <= 1 then [0] else [] end, case when list_max({bins}) >= {n} - 2 then [({n} - 1)::int] else [] end)))"
    )


def _ranges(bins: str) -> str:
    return (
        f"list_transform(list_zip(list_filter({bins}, lambda x: not list_contains({bins}, x - 1)), list_filter({bins}, lambda x: not list_contains({bins}, x + 1))), "
        "lambda z: {'start': z[1]::int, 'end': z[2]::int})"
    )




def _place(k: int) -> str:
    """The points that the shift of place k takes: nearest unused points, cut into runs, rising, long enough."""
    unused = "" if k == 1 else f"and not exists (select 1 from taken_{k - 1} t where t.a = p.a and t.b = p.b and t.i = p.i) and not exists (select 1 from taken_{k - 1} t where t.a = p.a and t.b = p.b and t.j = p.j)"
    near = f"""select o.a, o.b, p.i, min({{'off': abs(p.j - p.i - o.shift), 'distance': p.distance, 'j': p.j}}) as m from ranked_offsets o join points p on p.a = o.a and p.b = o.b
        where o.place = {k} and abs(p.j - p.i - o.shift) <= 1 {unused} group by all"""
    marks = f"select a, b, i, m.j as j, m.distance as distance, case when i - lag(i) over (partition by a, b order by i) <= 2 then 0 else 1 end as new from ({near})"
    segments = f"select *, sum(new) over (partition by a, b order by i rows unbounded preceding) as run from ({marks})"
    sized = f"select *, count(*) over w as n, max(i) over w - min(i) over w + 1 as span, max(j) over (partition by a, b, run order by i rows between unbounded preceding and 1 preceding) as top from ({segments}) window w as (partition by a, b, run)"
    least = int(P.min_segment)
    risen = f"select *, count(*) over (partition by a, b, run) as m from ({sized}) where n >= {least} and span >= {least} and (top is null or j > top)"
    got = f"select a, b, i, j, distance from ({risen}) where m >= {least}"
    return got if k == 1 else f"select * from taken_{k - 1} union all {got}"


CTES: dict[str, str] = {f"taken_{k}": _place(k) for k in range(1, P.top_offsets + 1)} | {
    "items": f"""select doc_id as item_id, '/' || source || '/' || lang || '/doc' || doc_id || '.txt' as path, strlen(text) as size_bytes, doc_id as mtime_ns,
        len({_SPLIT})::double as duration_seconds, n_chars::bigint as width, 1::bigint as height, 'text' as codec, sha256(text) as sha256, len({_SPLIT})::bigint as detailed_sample_count from documents""",
    "sentences": f"select item_id, unnest(range(len(s)))::int as pos, unnest(s) as sentence from (select doc_id as item_id, {_SPLIT} as s from documents)",
    "words": "select item_id, pos, least(255, length(sentence))::int as mean, md5(w) as h from (select item_id, pos, sentence, unnest(string_split(sentence, ' ')) as w from sentences) where w <> ''",
    "votes": "select item_id, pos, mean, " + ", ".join(f"('0x' || substr(h, {4 * k + 1}, 4))::int as v{k}" for k in range(8)) + " from words",
    "samples": f"select item_id, pos, pos::double as ts, any_value(mean) as mean, {_VOTES} from votes group by item_id, pos",
    "fast": "select * from samples where b0 % 4 = 0",
    "usable": f"select * from samples where not {_FLAT}",
    "tokens": f"select distinct item_id, unnest({_TOKENS}) as token from usable",
    "mixed0": f"select item_id, token, ((token::uhugeint + 11400714819323198485) % {_2_64})::ubigint as x from tokens",
    "mixed1": f"select item_id, token, ((xor(x, x >> 30)::uhugeint * 13787848793156543929) % {_2_64})::ubigint as x from mixed0",
    "mixed2": f"select item_id, token, ((xor(x, x >> 27)::uhugeint * 10723151780598845931) % {_2_64})::ubigint as x from mixed1",
    "mixed": "select item_id, token, xor(x, x >> 31) as h from mixed2",
    "reserved": f"select *, token < 524288 and row_number() over (partition by item_id, token < 524288 order by h) <= {(P.token_limit + 1) // 2} as kept from mixed",
    "selected": f"select item_id, token from (select *, row_number() over (partition by item_id order by kept desc, h) as n from reserved) where n <= {P.token_limit}",
    "frequency": "select token, count(*) as n from selected group by token",
    "rare": f"select item_id, token from selected where token in (select token from frequency where n <= {P.max_frequency})",
    "scores": "select x.item_id as a, y.item_id as b, count(*) as score from rare x join rare y on x.token = y.token and x.item_id < y.item_id group by all",
    "shared": f"select * from scores where score >= {P.min_shared}",
    "capped": f"""select distinct least(a, b) as a, greatest(a, b) as b from (select *, row_number() over (partition by a order by score desc, b desc) as n
        from (select a, b, score from shared union all select b, a, score from shared)) where n <= {P.per_item}""",
    "exact_sets": """select size_bytes, sha256, min(item_id) as anchor, count(*) as n from items
        where size_bytes in (select size_bytes from items group by size_bytes having count(*) > 1) group by all having count(*) > 1""",
    "keyed": "select item_id, anchor, duration_seconds from items join exact_sets using (size_bytes, sha256)",
    "exact_pairs": "select x.item_id as a, y.item_id as b from keyed x join keyed y on x.anchor = y.anchor and x.item_id < y.item_id",
    "star": f"""select k.anchor as a_id, k.item_id as b_id, 'exact' as kind, round(least(k.duration_seconds, i.duration_seconds), 3) as overlap_seconds, 100.0::double as a_duplicated_percent,
        100.0::double as b_duplicated_percent, 1.0::double as confidence, {_NONE} as a_sample_ranges, {_NONE} as b_sample_ranges from keyed k join items i on i.item_id = k.anchor where k.item_id <> k.anchor""",
    "candidates": "select a, b from capped c where not exists (select 1 from exact_pairs e where e.a = c.a and e.b = c.b)",
    "fast_usable": f"select * from fast where not {_FLAT}",
    "fast_tokens": f"select item_id, pos, unnest(list_distinct({_TOKENS})) as token from fast_usable",
    "fast_met": "select distinct c.a, c.b, x.pos as i, y.pos as j from candidates c join fast_tokens x on x.item_id = c.a join fast_tokens y on y.item_id = c.b and y.token = x.token",
    "fast_points": f"select m.*, x.ts as ts_a, y.ts as ts_b, ({_DISTANCE})::int as distance from fast_met m join fast_usable x on x.item_id = m.a and x.pos = m.i join fast_usable y on y.item_id = m.b and y.pos = m.j",
    "support": f"select a, b, round_even((ts_b - ts_a) / 2.0, 0)::bigint as bucket, count(distinct i) as n_left, count(distinct j) as n_right from fast_points where distance <= {P.distance} group by all",
    "likely": f"""select distinct s.a, s.b from support s join items x on x.item_id = s.a join items y on y.item_id = s.b
        where least(n_left, n_right) >= case when least(x.duration_seconds, y.duration_seconds) < {P.min_segment} then 1 else 2 end""",
    "deep_tokens": f"select item_id, pos, unnest(list_distinct({_TOKENS})) as token from usable",
    "deep_met": "select distinct c.a, c.b, x.pos as i, y.pos as j from likely c join deep_tokens x on x.item_id = c.a join deep_tokens y on y.item_id = c.b and y.token = x.token",
    "deep_points": f"select m.*, ({_DISTANCE})::int as distance from deep_met m join usable x on x.item_id = m.a and x.pos = m.i join usable y on y.item_id = m.b and y.pos = m.j",
    "points": f"select a, b, i, j, distance from deep_points where distance <= {P.distance}",
    "offset_counts": "select a, b, j - i as shift, count(*) as votes from points group by all",
    "ranked_offsets": "select *, row_number() over (partition by a, b order by votes desc, shift desc) as place from offset_counts",
    "chosen": """select a, b, shift, i, m.j as j, m.distance as distance from (select o.a, o.b, o.shift, p.i, min({'off': abs(p.j - p.i - o.shift), 'distance': p.distance, 'j': p.j}) as m
        from ranked_offsets o join points p on p.a = o.a and p.b = o.b and abs(p.j - p.i - o.shift) <= 1 where o.place = 1 group by all)""",
    "run_marks": "select *, case when i - lag(i) over (partition by a, b order by i) <= 2 then 0 else 1 end as new from chosen",
    "run_numbers": "select a, b, shift, i, j, distance, sum(new) over (partition by a, b order by i rows unbounded preceding)::int as run from run_marks",
    "long_runs": f"""select * from (select *, count(*) over w as n, max(i) over w - min(i) over w + 1 as span from run_numbers window w as (partition by a, b, run))
        where n >= {int(P.min_segment)} and span >= {int(P.min_segment)}""",
    "rising": "select * from (select *, max(j) over (partition by a, b, run order by i rows between unbounded preceding and 1 preceding) as top from long_runs) where top is null or j > top",
    "aligned": f"select a, b, i, j, distance from (select *, count(*) over (partition by a, b, run) as m from rising) where m >= {int(P.min_segment)}",
    "counts": "select item_id, count(*)::bigint as n from samples group by item_id",
    "paired": f"select a, b, list_sort(list_distinct(list(i))) as p, list_sort(list_distinct(list(j))) as q, greatest(0.0, 1.0 - avg(distance) / 28) as sure from taken_{P.top_offsets} group by all",
    "normal": f"select a, b, sure, x.n as na, y.n as nb, {_normal('p', 'x.n')} as ca, {_normal('q', 'y.n')} as cb from paired join counts x on x.item_id = a join counts y on y.item_id = b",
    "records": f"""select a as a_id, b as b_id, 'perceptual' as kind, round(least(least(len(ca), len(cb))::double, x.duration_seconds, y.duration_seconds), 3) as overlap_seconds,
        round(least(100.0, 100.0 * len(ca) / greatest(1, na)), 2) as a_duplicated_percent, round(least(100.0, 100.0 * len(cb) / greatest(1, nb)), 2) as b_duplicated_percent, round(sure, 4) as confidence,
        {_ranges('ca')} as a_sample_ranges, {_ranges('cb')} as b_sample_ranges from normal join items x on x.item_id = a join items y on y.item_id = b""",
    "all_matches": "select * from star union all select * from records",
    "matches": "select row_number() over (order by a_id, b_id) as match_id, * from all_matches where greatest(a_duplicated_percent, b_duplicated_percent) + 1e-9 >= 50.0",
    "sides": """select match_id, kind, a_id as item_id, b_id as other_id, a_sample_ranges as ranges, a_duplicated_percent as percent from matches
        union all select match_id, kind, b_id, a_id, b_sample_ranges, b_duplicated_percent from matches""",
    "item_n": "select item_id, coalesce(nullif(detailed_sample_count, 0), greatest(1, ceil(duration_seconds / 1.0)::bigint)) as n from items",
    "bins": """select distinct match_id, item_id, other_id, kind, unnest(case when kind = 'exact' then range(0, n) else flatten(list_transform(ranges, lambda r: range(r['start'], r['end'] + 1))) end)::int as bin
        from sides join item_n using (item_id)""",
    "exact_edges": "select a_id as a, b_id as b from matches where kind = 'exact'",
    "exact_reach": "@" + _CLOSURE.format(a="a", b="b", edges="exact_edges") + " union select r.a, e.b from exact_reach r join (select a, b from exact_edges union select b, a from exact_edges) e on e.a = r.b",
    "classes": "select item_id, least(item_id, coalesce(low, item_id)) as class_id from items left join (select a, min(b) as low from exact_reach group by a) on a = item_id",
    "clip_sides": """select match_id, ca as class_id, a_sample_ranges as ranges from ends union all select match_id, cb, b_sample_ranges from ends where ca <> cb""",
    "ends": "select m.*, x.class_id as ca, y.class_id as cb from matches m join classes x on x.item_id = m.a_id join classes y on y.item_id = m.b_id where kind <> 'exact'",
    "clip_bins": "select distinct match_id, class_id, unnest(flatten(list_transform(ranges, lambda r: range(r['start'], r['end'] + 1))))::int as bin from clip_sides",
    "clip_edges": "select x.match_id as a, min(y.match_id) as b from clip_bins x join clip_bins y on x.class_id = y.class_id and x.bin = y.bin group by x.match_id, x.class_id, x.bin",
    "clip_reach": "@" + _CLOSURE.format(a="a", b="b", edges="clip_edges") + " union select r.a, e.b from clip_reach r join (select a, b from clip_edges union select b, a from clip_edges) e on e.a = r.b",
    "clips": "select a as match_id, min(b) as component from clip_reach group by a",
    "clip_classes": "select distinct component, class_id from clips join clip_sides using (match_id)",
    "clip_members": "select distinct component, item_id from clip_classes join classes using (class_id)",
    "exact_in": "select match_id, class_id from matches join classes on item_id = a_id where kind = 'exact'",
    "clip_matches": "select component, match_id from clips union select component, match_id from clip_classes join exact_in using (class_id)",
    "alone": """select class_id, item_id from classes where class_id in (select class_id from classes group by class_id having count(*) > 1)
        and class_id not in (select class_id from sides join classes using (item_id) where kind <> 'exact')""",
    "sources": "select 0 as kind, component as id, item_id from clip_members union all select 1, class_id, item_id from alone",
    "sets": "select kind, id, list_sort(list(item_id)) as members from sources group by kind, id",
    "set_ids": "select members, row_number() over (order by members[1], len(members), members) as group_id from (select distinct members from sets)",
    "members": "select group_id, unnest(members) as item_id from set_ids",
    "used": """select distinct group_id, match_id from sets join set_ids using (members) join (select 0 as kind, component as id, match_id from clip_matches
        union all select 1, class_id, match_id from exact_in where class_id in (select class_id from alone)) using (kind, id)""",
    "group_bins": "select m.group_id, b.item_id, count(distinct b.bin) as bins, list_sort(list_distinct(list(b.other_id))) as others from members m join bins b using (item_id) join members o on o.group_id = m.group_id and o.item_id = b.other_id where b.kind <> 'exact' group by all",
    "group_exact": "select m.group_id, m.item_id, list_sort(list_distinct(list(o.item_id))) as others from members m join classes x using (item_id) join members o on o.group_id = m.group_id and o.item_id <> m.item_id join classes y on y.item_id = o.item_id and y.class_id = x.class_id group by all",
    "covered": """select m.group_id, m.item_id, case when e.others is not null then 100.0 else least(100.0, 100.0 * coalesce(p.bins, 0) / n) end as covered_percent, case when e.others is null then coalesce(p.others, []) when m.item_id < e.others[1] then [e.others[-1]] else [e.others[1]] end as sources, len(coalesce(e.others, p.others, []))::bigint as n_sources
        from members m join item_n using (item_id) left join group_exact e using (group_id, item_id) left join group_bins p using (group_id, item_id)""",
    "named": "select m.group_id, i.*, string_split(path, '/')[-1] as name from members m join items i using (item_id)",
    "prior": "select group_id, item_id, row_number() over (partition by group_id order by length(name), width * height, size_bytes, duration_seconds, path) as place from named",
    "user_bins": "select distinct user_id as item_id, (floor((epoch(ts) - epoch(timestamp '2024-01-01')) / 3600))::int as bin from events",
    "user_islands": "select *, bin - row_number() over (partition by item_id order by bin) as island from user_bins",
    "user_ranges": "select item_id, min(bin) as \"start\", max(bin) as \"end\" from user_islands group by item_id, island",
    "decided": "select group_id, list_sort(list(item_id) filter (place > 1)) as removal_order, list(item_id) filter (place = 1) as keeper_ids from prior where group_id % 2 = 1 group by group_id",
    "asked": "select group_id, unnest(range(len(removal_order)))::int as place, unnest(removal_order) as item_id from decided",
    "kept": "select distinct unnest(keeper_ids) as item_id from decided",
    "wanted": "select item_id, arg_min({'g': group_id, 'p': place}, {'g': group_id, 'p': place}) as f from asked where item_id not in (select item_id from kept) group by item_id",
    "kept_exact": "select w.item_id, list_sort(list_distinct(list(k.item_id))) as others from wanted w join classes x using (item_id) join kept k on k.item_id <> w.item_id join classes y on y.item_id = k.item_id and y.class_id = x.class_id group by all",
    "kept_bins": "select b.item_id, count(distinct b.bin) as bins, list_sort(list_distinct(list(b.other_id))) as others from bins b join kept k on k.item_id = b.other_id where b.kind <> 'exact' and b.item_id in (select item_id from wanted) group by all",
    "actions": """select item_id, f.g as group_id, f.p as place, round(c, 2) as covered_percent, sources, n_sources from (select w.item_id, w.f, case when e.others is not null then 100.0 else least(100.0, 100.0 * coalesce(p.bins, 0) / n) end as c,
        case when e.others is null then coalesce(p.others, []) else [e.others[1]] end as sources, len(coalesce(e.others, p.others, []))::bigint as n_sources from wanted w join item_n using (item_id) left join kept_exact e using (item_id) left join kept_bins p using (item_id)) where len(sources) > 0 and c + 1e-9 >= 95.0""",
    "inventory": "select item_id, case when item_id % 7 = 0 then size_bytes + 1 else size_bytes end as size_bytes, mtime_ns from items where item_id % 11 <> 0",
    "drift": "select i.item_id, case when v.item_id is null then 'missing' when v.size_bytes = i.size_bytes and v.mtime_ns = i.mtime_ns then 'ok' else 'changed' end as status from items i left join inventory v using (item_id)",
}


def _walk(order: str) -> str:
    """The removal walk through an order, one place of all groups a step."""
    return f"""@select group_id, 0::bigint as k, list(item_id) as kept, null::bigint as gone from members group by group_id
        union all select group_id, k + 1, case when ok then list_filter(kept, lambda x: x <> item_id) else kept end, case when ok then item_id end from (
        select w.group_id, w.k, w.kept, p.item_id, len(w.kept) > 1 and case when len(list_intersect(t.mates, w.kept)) > 1 then 100.0 else least(100.0, 100.0 * count(distinct b.bin) / n.n) end + 1e-9 >= {P.min_coverage} as ok
        from walk_{order} w join {order} p on p.group_id = w.group_id and p.place = w.k + 1 join mates t on t.group_id = p.group_id and t.item_id = p.item_id join item_n n on n.item_id = p.item_id
        left join direct_bins b on b.group_id = w.group_id and b.item_id = p.item_id and list_contains(w.kept, b.other_id) group by w.group_id, w.k, w.kept, p.item_id, t.mates, n.n)"""


CTES |= {
    "pair_cover": """select u.group_id, b.item_id, b.other_id, case when bool_or(b.kind = 'exact') then 100.0 else least(100.0, 100.0 * count(distinct bin) / n) end + 1e-9 as c
        from bins b join used u using (match_id) join item_n using (item_id) group by u.group_id, b.item_id, b.other_id, n""",
    "contained": """select x.group_id, x.other_id as item_id, count(*) as contained from pair_cover x join pair_cover y on x.group_id = y.group_id and x.item_id = y.other_id and x.other_id = y.item_id
        where x.c >= 95 and y.c < 95 group by all""",
    "fully": """select n.group_id, n.item_id, row_number() over (partition by n.group_id order by coalesce(c.contained, 0), -v.covered_percent, width * height, size_bytes, duration_seconds, path) as place
        from named n join covered v using (group_id, item_id) left join contained c using (group_id, item_id)""",
    "mates": "select m.group_id, m.item_id, list(o.item_id) as mates from members m join classes x using (item_id) join members o on o.group_id = m.group_id join classes y on y.item_id = o.item_id and y.class_id = x.class_id group by all",
    "direct_bins": "select distinct u.group_id, b.item_id, b.other_id, b.bin from bins b join used u using (match_id) where b.kind <> 'exact' and b.item_id <> b.other_id",
    "walk_prior": _walk("prior"),
    "walk_fully": _walk("fully"),
}

#: The same grouping once more, of what is left after half of the planned removals were done.
_AGAIN = ("exact_edges", "exact_reach", "classes", "clip_sides", "ends", "clip_bins", "clip_edges", "clip_reach", "clips", "clip_classes", "clip_members", "exact_in", "alone", "sources", "sets", "set_ids", "members", "sides")
CTES |= {f"{name}_left": re.sub(rf"\b({'|'.join((*_AGAIN, 'items', 'matches'))})\b", r"\1_left", CTES[name]) for name in _AGAIN}
CTES |= {
    "resolved": "select item_id from actions where item_id % 2 = 0",
    "complete": "select group_id from asked group by group_id having bool_and(item_id in (select item_id from resolved))",
    "hidden": """select item_id from resolved union select item_id from members where group_id in (select group_id from complete)
        and item_id not in (select item_id from members where group_id not in (select group_id from complete))""",
    "items_left": "select * from items where item_id not in (select item_id from hidden)",
    "matches_left": "select * from matches where a_id not in (select item_id from hidden) and b_id not in (select item_id from hidden)",
}

KEPT = ("samples", "ranked_offsets", "records", "matches", "points", "fast_points", "members", "bins", "classes", "covered", "actions", "hidden", "matches_left", "classes_left")


def sql(body: str) -> str:
    """The body after all parts that it needs; parts marked @ are recursive."""
    need: dict[str, None] = {}

    def visit(text: str) -> None:
        for word in re.findall(r"[a-z_0-9]+", text):
            if word in CTES and word not in need and re.search(rf"(?:from|join)\s+{word}\b", text):
                need[word] = None
                visit(CTES[word])
                need[word] = need.pop(word)  # after its own needs

    visit(body)
    parts = ", ".join(f"{name} as ({CTES[name].removeprefix('@')})" if name not in KEPT and not name.startswith("taken_") else f"{name} as materialized ({CTES[name]})" for name in need)
    return f"with recursive {parts} {body}" if parts else body
