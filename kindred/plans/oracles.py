"""The catalogue's queries as SQL of another engine, for comparison. Fragments are built from the same word lists."""

from __future__ import annotations

import numpy as np

from ..functions.vocab import ADDRESS_WORDS, LEGAL_SUFFIXES, STOPWORDS

CAP, TOP = 200, 50


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


SUFFIX, STOP, SHORT, FULL = _list(LEGAL_SUFFIXES), _list(STOPWORDS), _list(ADDRESS_WORDS), _list(ADDRESS_WORDS.values())

PART = """r as (select 'S' || (p_partkey % 3 + 1) || '-' || lpad(cast(p_partkey as varchar), 7, '0') as entity_id, p_partkey % 3 + 1 as source, (p_partkey % 3 + 1) * 1000000000000000 + p_partkey as ord,
    coalesce(p_name, '') as business_name, concat_ws(' ', p_brand, cast(p_size as varchar)) as business_address, coalesce(p_type, '') as country from part)"""
DOCS = """r as (select 'S' || (doc_id % 3 + 1) || '-' || lpad(cast(doc_id as varchar), 7, '0') as entity_id, doc_id % 3 + 1 as source, (doc_id % 3 + 1) * 1000000000000000 + doc_id as ord,
    coalesce(text, '') as business_name, concat_ws(' ', source, cast(n_chars as varchar)) as business_address, coalesce(lang, '') as country from documents)"""
TRUTH = """g as (select distinct 'S1-' || lpad(cast(a.p_partkey as varchar), 7, '0') as s1_id, 'S' || (b.p_partkey % 3 + 1) || '-' || lpad(cast(b.p_partkey as varchar), 7, '0') as target_id
    from part a join part b on a.p_name = b.p_name and a.p_brand = b.p_brand where a.p_partkey % 3 = 0 and b.p_partkey % 3 <> 0)"""


def clean(x: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace(strip_accents(coalesce({x}, '')), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"


def tok(clean_column: str) -> str:
    return f"list_filter(string_split({clean_column}, ' '), lambda t: t <> '')"


def no_suffix(a: str) -> str:
    return f"list_filter({a}, lambda t: length(t) > 1 and not list_contains({SUFFIX}, t))"


def expanded(a: str) -> str:
    return f"list_transform({a}, lambda t: coalesce({FULL}[nullif(list_position({SHORT}, t), 0)], t))"


def no_stop(a: str) -> str:
    return f"list_filter({a}, lambda t: not list_contains({STOP}, t))"


DIGITS = "regexp_full_match(t, '[0-9]+')"


def canon_name(a: str) -> str:
    return f"array_to_string(list_sort(list_distinct({no_stop(no_suffix(a))})), ' ')"


def canon_addr(a: str) -> str:
    w = no_stop(expanded(a))
    return f"array_to_string(list_concat(list_filter({w}, lambda t: {DIGITS}), list_sort(list_filter({w}, lambda t: not {DIGITS} and length(t) > 1))), ' ')"


def grams(canon: str) -> str:
    s = f"(' ' || {canon} || ' ')"
    part = lambda n: f"list_transform(range(1, greatest(length({s}) - {n - 2}, 1)), lambda i: substring({s}, i, {n}))"
    return f"case when {canon} = '' then cast([] as varchar[]) else list_distinct(list_concat({part(2)}, {part(3)})) end"


def norm(x: str, sep: str) -> str:
    return f"lower(trim(regexp_replace(coalesce({x}, ''), '[^a-zA-Z0-9]+', '{sep}', 'g')))"


def soundex(t: str) -> str:
    """One replacement for each code, as this engine's patterns have no reference to a group."""
    s = f"translate(substring(upper({t}), 2), 'BFPVCGJKQSXZDTLMNRAEHIOUWY', '11112222222233455600000000')"
    for d in "0123456":
        s = f"regexp_replace({s}, '{d}+', '{d}', 'g')"
    return f"rpad(substring(upper({t}), 1, 1) || replace({s}, '0', ''), 4, '0')"


def joined(a: str) -> str:
    return f"array_to_string(list_sort({a}), '|')"


def sizes(a: str, b: str) -> tuple[str, str, str]:
    return f"len(list_intersect({a}, {b}))", f"len({a})", f"len({b})"


def _empties(a: str, b: str, value: str) -> str:
    return f"case when len({a}) = 0 and len({b}) = 0 then 1.0 when len({a}) = 0 or len({b}) = 0 then 0.0 else {value} end"


def jaccard(a: str, b: str) -> str:
    c, n, m = sizes(a, b)
    return _empties(a, b, f"cast({c} as double) / ({n} + {m} - {c})")


def dice(a: str, b: str) -> str:
    c, n, m = sizes(a, b)
    return _empties(a, b, f"2.0 * cast({c} as double) / ({n} + {m})")


def overlap(a: str, b: str) -> str:
    c, n, m = sizes(a, b)
    return _empties(a, b, f"cast({c} as double) / least({n}, {m})")


def contain(a: str, b: str) -> str:
    c, n, m = sizes(a, b)
    return f"case when {n} = 0 then case when {m} = 0 then 1.0 else 0.0 end else cast({c} as double) / {n} end"


def lev(a: str, b: str) -> str:
    return f"case when {a} = {b} then 1.0 when {a} = '' or {b} = '' then 0.0 else 1 - cast(levenshtein({a}, {b}) as double) / greatest(length({a}), length({b})) end"


def r8(x: str) -> str:
    return f"round(cast({x} as double), 8)"


#: Records with tokens and canonical forms, from r.
READY = f"""
c as (select *, {clean("business_name")} as name_clean, {clean("business_address")} as addr_clean, lower(trim(country)) as cn from r),
t as (select *, {tok("name_clean")} as ntok, {tok("addr_clean")} as atok from c),
k as (select *, {canon_name("ntok")} as name_canon, {canon_addr("atok")} as addr_canon from t)"""

FULL_READY = f"""{READY},
f as (select entity_id, source, name_clean, addr_clean, cn as country, name_canon, addr_canon, {no_suffix("ntok")} as name_list, list_distinct({no_suffix("ntok")}) as name_tok,
    list_filter({expanded("atok")}, lambda t: {DIGITS} or length(t) > 1) as addr_list, list_distinct(list_filter({expanded("atok")}, lambda t: {DIGITS} or length(t) > 1)) as addr_tok,
    list_sort(list_distinct(list_filter(ntok, lambda t: {DIGITS}))) as name_dig, list_sort(list_distinct(list_filter(atok, lambda t: {DIGITS}))) as addr_dig, {grams("name_canon")} as name_ng, {grams("addr_canon")} as addr_ng,
    list_distinct(list_transform(list_filter({no_suffix("ntok")}, lambda t: regexp_full_match(t, '[a-z]+') and length(t) >= 3)[1:4], lambda t: {soundex("t")})) as name_sx from k)"""

KEYS = f"""{READY},
e as (select entity_id, source, ord, unnest([
    {{'t': 'name', 'k': name_canon, 's': 100}}, {{'t': 'addr', 'k': addr_canon, 's': 90}},
    {{'t': 'country_name', 'k': case when cn <> '' and name_canon <> '' then cn || '|' || substring(name_canon, 1, 4) else '' end, 's': 60}},
    {{'t': 'country_addr', 'k': case when cn <> '' and addr_canon <> '' then cn || '|' || substring(addr_canon, 1, 4) else '' end, 's': 50}}]) as x from k),
keys as (select entity_id, source, ord, x.t as key_type, x.k as key, x.s as key_score from e where x.k <> '')"""
CAPPED = f"{KEYS}, capped as (select * from keys where source > 1 qualify row_number() over (partition by key_type, key order by ord) <= {CAP})"
SCORED = f"""{CAPPED}, scored as (select a.entity_id as s1_id, b.entity_id as target_id, max(b.key_score) as score, min(b.ord) as ord
    from keys a join capped b using (key_type, key) where a.source = 1 and a.entity_id <> b.entity_id group by all)"""
TOPPED = f"{SCORED}, top as (select *, row_number() over (partition by s1_id order by score desc, ord) as rank from scored qualify rank <= {TOP})"

NORMED = f"""n as (select entity_id, source, ord, {norm("business_name", "")} as name, {norm("business_address", "")} as addr, lower(trim(country)) as country from r),
one as (select * from n where source = 1),
two as (select *, count(*) over (partition by country, name) as name_count, count(*) over (partition by country, addr) as addr_count, count(*) over (partition by country, name, addr) as full_count from n where source > 1)"""
_NAME, _ADDR = "a.name = b.name and a.name <> ''", "a.addr = b.addr and a.addr <> ''"
RULE_SQL = {
    "FULL_EXACT_UNIQUE": f"{_NAME} and {_ADDR} and b.full_count = 1",
    "NAME_UNIQUE": f"{_NAME} and b.name_count = 1",
    "ADDRESS_UNIQUE": f"{_ADDR} and b.addr_count = 1",
    "NAME_AND_ADDRESS": f"{_NAME} and {_ADDR}",
    "V1_ORIGINAL": f"(({_NAME}) or ({_ADDR}))",
    "NAME_ONLY": _NAME,
    "ADDRESS_ONLY": _ADDR,
    "NAME_UNIQUE_OR_ADDRESS_UNIQUE": f"(({_NAME} and b.name_count = 1) or ({_ADDR} and b.addr_count = 1))",
}


def rule_pairs(rule: str) -> str:
    return f"select distinct a.entity_id as s1_id, b.entity_id as target_id from one a join two b on a.country = b.country and a.country <> '' and {RULE_SQL[rule]}"


RULED = f"with {PART}, {NORMED}, {TRUTH}, m as (" + " union all ".join(f"select '{x}' as rule, * from ({rule_pairs(x)})" for x in RULE_SQL) + ")"


def fbeta_sql(tp: str = "tp", p: str = "predicted", a: str = "actual") -> str:
    return f"case when {a} = 0 and {p} = 0 then 1.0 when {a} = 0 or {p} = 0 or {tp} = 0 then 0.0 else 1.25 * cast({tp} as double) / (0.25 * cast({a} as double) + {p}) end"


def f2_sql() -> str:
    return "case when actual = 0 and predicted = 0 then 1.0 when actual = 0 or predicted = 0 then 0.0 else 1.25 * cast(tp as double) / (1.25 * cast(tp as double) + 0.25 * (predicted - tp) + (actual - tp)) end"


PER_ENTITY = f"""{RULED},
u as (select rule, entity_id as s1_id from one cross join (select unnest({list(RULE_SQL)}) as rule)),
ga as (select s1_id, count(*) as actual from g group by 1),
pp as (select rule, m.s1_id, count(*) as predicted, count(g.target_id) as tp from m left join g on m.s1_id = g.s1_id and m.target_id = g.target_id group by 1, 2),
s as (select u.rule, u.s1_id, coalesce(actual, 0) as actual, coalesce(predicted, 0) as predicted, coalesce(tp, 0) as tp from u left join ga on u.s1_id = ga.s1_id left join pp on u.rule = pp.rule and u.s1_id = pp.s1_id)"""

#: Pairs whose features are compared: same country, equal names.
PAIRED = f"with {PART}, {NORMED}, {FULL_READY}, p as ({rule_pairs('V1_ORIGINAL')}), x as (select p.s1_id, p.target_id, a, b from p join f a on a.entity_id = p.s1_id join f b on b.entity_id = p.target_id)"


def side_features(p: str) -> dict[str, str]:
    ta, tb, ga, gb, ca, cb, ra, rb, da, db, la, lb = (f"{s}.{p}_{n}" for n in ("tok", "ng", "canon", "clean", "dig", "list") for s in "ab")
    c, n, m = sizes(ta, tb)
    low = f"least({n}, {m})"
    return {
        "jaccard_tokens": jaccard(ta, tb), "dice_tokens": dice(ta, tb), "overlap_tokens": overlap(ta, tb), "containment_ab": contain(ta, tb), "containment_ba": contain(tb, ta), "jaccard_ngrams": jaccard(ga, gb), "dice_ngrams": dice(ga, gb),
        "overlap_ngrams": overlap(ga, gb), "lev_canon": lev(ca, cb), "lev_raw": lev(ra, rb), "common_tokens": c, "common_ratio": f"case when {low} = 0 then 0.0 else cast({c} as double) / {low} end",
        "first_token_match": f"case when len({la}) > 0 and len({lb}) > 0 and {la}[1] = {lb}[1] then 1 else 0 end", "length_diff": f"cast(abs(length({ca}) - length({cb})) as double) / greatest(length({ca}), length({cb}), 1)",
        "length_ratio": f"cast(least(length({ca}), length({cb})) as double) / greatest(length({ca}), length({cb}), 1)", "digits_equal": f"case when len({da}) > 0 and {da} = {db} then 1 else 0 end",
    }


def top5(x: str) -> str:
    return f"list_transform(list_sort(list_transform({x}, lambda g: (100 - length(g)) || g))[1:5], lambda g: g[3:])"


COUNTRY = "case when a.country = '' or b.country = '' then 0.5 when a.country = b.country then 1.0 else 0.0 end"
QUICK = f"0.35 * ({jaccard('a.name_tok', 'b.name_tok')}) + 0.15 * ({jaccard('a.name_ng', 'b.name_ng')}) + 0.20 * ({jaccard('a.addr_tok', 'b.addr_tok')}) + 0.10 * ({jaccard('a.addr_ng', 'b.addr_ng')}) + 0.20 * ({COUNTRY})"
_flag = lambda c: f"case when {c} then 1 else 0 end"
GLOBALS = {
    "country_match": COUNTRY, "cross_jaccard": jaccard("list_intersect(a.name_tok, a.addr_tok)", "list_intersect(b.name_tok, b.addr_tok)"),
    "soundex_jaccard": f"case when len(a.name_sx) = 0 and len(b.name_sx) = 0 then 0.0 else {jaccard('a.name_sx', 'b.name_sx')} end",
    "name_top5_ngrams": jaccard(top5("a.name_ng"), top5("b.name_ng")), "addr_top5_ngrams": jaccard(top5("a.addr_ng"), top5("b.addr_ng")), "quick_score": QUICK,
    "name_either_empty": _flag("len(a.name_tok) = 0 or len(b.name_tok) = 0"), "addr_either_empty": _flag("len(a.addr_tok) = 0 or len(b.addr_tok) = 0"), "name_both_empty": _flag("len(a.name_tok) = 0 and len(b.name_tok) = 0"),
    "addr_both_empty": _flag("len(a.addr_tok) = 0 and len(b.addr_tok) = 0"), "raw_exact_name": _flag("a.name_clean = b.name_clean and a.name_clean <> ''"), "raw_exact_addr": _flag("a.addr_clean = b.addr_clean and a.addr_clean <> ''"),
    "canon_exact_name": _flag("a.name_canon = b.name_canon and a.name_canon <> ''"), "canon_exact_addr": _flag("a.addr_canon = b.addr_canon and a.addr_canon <> ''"),
}
SIDES = {f"{p}_{k}": v for p in ("name", "addr") for k, v in side_features(p).items()}


def features_sql(names: list[str]) -> str:
    every = SIDES | GLOBALS
    return f"{PAIRED} select s1_id, target_id, " + ", ".join(f"{r8(every[n])} as {n}" for n in names) + " from x"


def proba_sql(weights: dict[str, float], bias: float) -> str:
    every = SIDES | GLOBALS
    z = " + ".join([str(bias), *(f"{w} * ({every[n]})" for n, w in weights.items())])
    return f"{PAIRED}, w as (select s1_id, target_id, round(1 / (1 + exp(-(cast({z} as double)))), 6) as proba from x)"


def curve_sql(weights: dict[str, float], bias: float) -> str:
    levels = ", ".join(f"({float(t)!r}::double)" for t in np.arange(0.05, 0.96, 0.01))
    return f"""{proba_sql(weights, bias)}, {TRUTH}, th(threshold) as (values {levels}), u as (select distinct s1_id from w), ga as (select s1_id, count(*) as actual from g group by 1),
        z as (select threshold, u.s1_id, coalesce(any_value(actual), 0) as actual, count(w.target_id) as predicted, count(g.target_id) as tp
            from th cross join u left join w on w.s1_id = u.s1_id and w.proba >= threshold left join g on g.s1_id = w.s1_id and g.target_id = w.target_id left join ga on ga.s1_id = u.s1_id group by 1, 2)
        select threshold, round(avg({fbeta_sql()}), 8) as macro_fbeta from z group by 1"""


#: A submission with planted faults.
FAULTY = f"""with {PART}, {NORMED}, q as ({rule_pairs("NAME_ONLY")}), l as (select s1_id, list(target_id order by target_id) as ids from q group by 1),
b as (select entity_id as s1_id, cast(substring(entity_id, 4) as bigint) as key, coalesce(ids, []) as ids from one left join l on l.s1_id = one.entity_id),
d as (select case when key % 29 = 0 then 'S1-X' || key else s1_id end as s1_id, key,
    list_concat(ids, case when key % 7 = 0 then ids[1:1] else [] end, case when key % 11 = 0 then ['S1-0000000'] else [] end, case when key % 13 = 0 then ['X9-' || key] else [] end, case when key % 17 = 0 then ['S2-Z' || key] else [] end) as ids from b where key % 23 <> 0),
rows as (select s1_id, ids from d union all select s1_id, ids from d where key % 19 = 0),
items as (select s1_id, unnest(ids) as id from rows),
v as (select 'V05' as check_id, s1_id as example from rows group by s1_id having count(*) > 1
    union all select distinct 'V06', s1_id from (select s1_id, id from items group by 1, 2 having count(*) > 1)
    union all select distinct 'V07', id from items where id like 'S1-%'
    union all select distinct 'V08', id from items where id not like 'S1-%' and id not like 'S2-%' and id not like 'S3-%'
    union all select distinct 'V09', id from items where (id like 'S2-%' or id like 'S3-%') and id not in (select entity_id from two)
    union all select 'V10', entity_id from one where entity_id not in (select s1_id from rows)
    union all select distinct 'V11', s1_id from rows where s1_id not in (select entity_id from one))"""
