"""SQL for what the scan finds, written from the pattern file and the rules, not from the code under test."""

from __future__ import annotations

from cinderglass.functions import detect, views
from cinderglass.functions.catalog import HIGH, LOW, MEDIUM, Catalog

LEVELS = (HIGH, MEDIUM, LOW)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def alternation(severity: str) -> str:
    """A regex of all literals, the longest first."""
    special = "\\.+*?()|[]{}^$"
    words = sorted({p.lower() for p in Catalog.default().patterns(severity)}, key=lambda p: (-len(p), p))
    return quoted("|".join("".join("\\" + c if c in special else c for c in w) for w in words))


def entities(low: str) -> str:
    out = f"regexp_replace(regexp_replace({low}, '&#x([0-9a-f]{{2}});', '\\\\x\\1', 'g'), '&#([0-9]{{2,3}});', 'ENTITY_\\1', 'g')"
    for seen, meant in [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')] + [(f"ENTITY_{ord(x)}", x) for x in "abcdefghijklmnopqrstuvwxyz"]:
        out = f"replace({out}, '{seen}', '{meant}')"
    return out


def collapsed(low: str) -> str:
    """Look-behind by doubled spaces: a match leaves the second space for the next one to begin with."""
    one = f"regexp_replace({low} || chr(10), '[ \\t\\n\\x0B\\f\\r]+', '  ', 'g')"
    two = f"regexp_replace({one}, '(^|[^a-z])([a-z])  ([a-z]) ', '\\1\\2\\3\x01', 'g')"
    joined = f"replace(replace({two}, '\x01 ', ''), '  ', ' ')"
    again = f"replace({joined}, ' ', '  ')"
    three = f"regexp_replace({again}, '(^|[^a-z])([a-z])  ([a-z])($|[^a-z])', '\\1\\2\\3\\4', 'g')"
    return f"replace({three}, '  ', ' ')"


#: Per view the SQL over ``lo``, the lower-case text.
VIEWS = {
    "lower": "lo",
    "collapsed": collapsed("lo"),
    "entity_decoded": entities("lo"),
    "stripped": f"regexp_replace(translate(lo, {quoted(views.STRIPPED)}, ''), '[ \\t\\r\\f\\x0B]+', ' ', 'g')",
    "confusable": f"regexp_replace(translate(lo, '{views.LOOKALIKES + views.WIDE}', '{views.LOOKALIKE_OF + views.PLAIN}'), '[\\x{{0300}}-\\x{{036F}}\\x{{FE00}}-\\x{{FE0F}}]', '', 'g')",
    "unicode_spaces": f"regexp_replace(translate(lo, '{views.SPACES}', '{' ' * len(views.SPACES)}'), ' +', ' ', 'g')",
    "tag_stripped": "regexp_replace(lo, '<[^>\\n]*>', '', 'g')",
    "percent_decoded": "lower(url_decode(lo))",
}
LEET = f"translate(lo, '{views.LEET_FROM}', '{views.LEET_TO}')"

PAYLOAD = f"""coalesce(len(list_filter(regexp_extract_all(c, '[A-Za-z0-9+/]{{50,}}={{0,2}}')[1:5], lambda x: regexp_matches(lower(decode(from_base64(x[1:(len(x) // 4) * 4]))), '{detect.BASE64_WORDS}'))) > 0, false)"""
PREFIX = "case " + " ".join(f"when contains(c, '{p}') then '{p}'" for p in detect.BASE64_PREFIXES) + " end"
PHRASE = "case " + " ".join(f"when contains({LEET}, '{p}') and not contains(lo, '{p}') then '{p}'" for p in detect.LEET_PHRASES) + " end"

#: Words that keep a match whatever surrounds it, in order.
GUARDS = ["ignore", "override", "bypass", "disregard", "forget", "instructions", "previous", "system prompt", "jailbreak", "discard", "supersede", "overwrite"]


def verdicts(rows: str) -> str:
    """CTEs up to ``judged``: per (id, p, pos) of ``rows(id, c, p, pos)`` the line, guard and context of p's first line."""
    guard = "case " + " ".join(f"when contains(low, '{g}') then '{g}'" for g in GUARDS) + " end"
    count = lambda regex: f"len(list_filter(before, lambda x: regexp_matches(x, {quoted(regex)})))"
    on = lambda *parts: f"regexp_matches(low, {' || '.join(p if p == 'q' else quoted(p) for p in parts)})"
    return f"""
split_ as (select *, string_split(c, chr(10)) as ls from {rows}),
found_ as (select *, list_position(list_transform(ls, lambda x: contains(lower(x), p)), true) as n from split_),
line_ as (select *, ls[n] as line, lower(ls[n]) as low, ls[greatest(1, n - 20):n - 1] as before, regexp_escape(p) as q from found_ where n > 0),
judged as (select id, p, pos, n, {guard} as guard, case
  when {count("^[ \\t]*(```|~~~)")} % 2 = 1 then 'code_fence'
  when {on("^[ \\t]*[a-z_][a-z0-9_]*:[ \\t]*[\"'].*", "q")} then 'yaml_string'
  when {count("^[ \\t]*[a-z_][a-z0-9_]*:[ \\t]*[|>]")} > 0 and regexp_matches(line, '^[ \\t]+') then 'yaml_block_scalar'
  when {on('"[^"]*', "q", '[^"]*"')} and ({on('"[^"]*"[ \\t]*:[ \\t]*"[^"]*', "q")} or {on('\\[[ \\t]*"[^"]*', "q")}) then 'json_string'
  when {count("(?i)<(code|pre)[^>]*>")} > {count("(?i)</(code|pre)>")} then 'html_code_block'
  when {on("<(code|pre)[^>]*>.*", "q", ".*</(code|pre)>")} then 'html_code_inline'
  when {on("`[^`]*", "q", "[^`]*`")} then 'markdown_inline_code' end as ctx from line_)"""


def findings(texts: str) -> str:
    """CTEs up to ``scanned(id, c, high, medium, low, cleared, severity)`` for ``texts``, a query of (id, c)."""
    cased: dict[tuple[str, str], str] = {}
    for s, _, p in Catalog.default().rows:
        cased.setdefault((s, p.lower()), p)
    names = ", ".join(f"({quoted(s)}, {quoted(low)}, {quoted(p)})" for (s, low), p in cased.items())
    clearable = ", ".join(quoted(p) for _, c, p in Catalog.default().rows if c == "generic_delimiters")
    seen = " union all ".join(f"select id, '{s}' as sev, k, regexp_extract_all(vs[k], {alternation(s)}) as ms from views_, (select unnest(range(1, {2 if s == LOW else 9})) as k)" for s in LEVELS)
    marks = [f"select id, '{s}' as sev, {10**12 + k} as pos, {quoted(name)} as m from low_ where regexp_matches(c, {quoted(regex)})" for k, (s, name, regex) in enumerate(detect.CODE_POINTS)]
    marks.append(f"select id, 'HIGH', {10**12 + 100}, {quoted(detect.BASE64_FINDING)} from low_ where {PAYLOAD}")
    marks.append(f"select id, 'HIGH', {10**12 + 101}, {quoted(detect.PREFIX_FINDING)} || x from (select id, {PREFIX} as x from low_) where x is not null")
    marks.append(f"select id, 'MEDIUM', {10**12 + 102}, {quoted(detect.LEET_FINDING)} || x from (select id, {PHRASE} as x from low_) where x is not null")
    return f"""
names_(sev, low, m) as (values {names}),
low_ as (select id, c, lower(c) as lo from ({texts})),
views_ as (select id, [{", ".join(VIEWS.values())}] as vs from low_),
seen_ as ({seen}),
each_ as (select id, sev, k, unnest(ms) as low, generate_subscripts(ms, 1) as i from seen_),
first_ as (select id, sev, low, min(k * 1000000 + i) as pos from each_ group by all),
all_ as (select id, sev, pos, names_.m as m from first_ join names_ using (sev, low) union all {" union all ".join(marks)}),
lists_ as (select id, coalesce(list(m order by pos) filter (sev = 'HIGH'), []) as high, coalesce(list(m order by pos) filter (sev = 'MEDIUM'), []) as medium, coalesce(list(m order by pos) filter (sev = 'LOW'), []) as low from all_ group by id),
clear_ as (select id, c, lower(p) as p, p as shown, pos from (select id, c, unnest(medium) as p, generate_subscripts(medium, 1) as pos from lists_ join low_ using (id) where len(high) = 0) where p in ({clearable})),
{verdicts("clear_")},
gone_ as (select id, list(p order by pos) as cleared from judged where guard is null and ctx is not null group by id),
scanned as (select id, c, coalesce(high, []) as high, list_filter(coalesce(medium, []), lambda x: not list_contains(coalesce(cleared, []), lower(x))) as medium, coalesce(low, []) as low, coalesce(cleared, []) as cleared,
  case when len(coalesce(high, [])) > 0 then 'HIGH' when len(list_filter(coalesce(medium, []), lambda x: not list_contains(coalesce(cleared, []), lower(x)))) > 0 then 'MEDIUM' when len(coalesce(low, [])) > 0 then 'LOW' else 'NONE' end as severity
  from low_ left join lists_ using (id) left join gone_ using (id))"""
