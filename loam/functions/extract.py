"""Scalar extractors: text and path in, value out. Each returns a SQL expression for a dialect."""

from __future__ import annotations

from loam.plans.dialect import Spark

#: Line ends as Python's str.splitlines has them.
NEWLINE = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{N}_]"
#: Phrases whose lines are no action markers.
NOT_MARKERS = ("todo/fixme", "todo markers", "todo marker", "todo_count", "open_todos", "action markers")
#: Signs of unfinished documents, and their labels.
PLACEHOLDERS = (
    (r"\btbd\b", "TBD"),
    (r"\bcoming soon\b", "coming soon"),
    (r"\bplaceholder\s*[:\-]", "placeholder label"),
    (r"\bnot implemented yet\b", "not implemented"),
    (r"\bstub\b", "stub"),
    (r"\bfill me\b", "fill me"),
    (r"\[\s*\]", "empty bracket"),
    (r"^\s*-\s*$", "empty bullet"),
)
#: What each of the patterns cannot match without.
PLACEHOLDER_PARTS = dict(zip((p for p, _ in PLACEHOLDERS), ("tbd", "coming soon", "placeholder", "not implemented yet", "stub", "fill me", "[", "-"), strict=True))
C_FAMILY = (".cpp", ".c", ".h", ".hpp", ".cc", ".cxx", ".hh", ".hxx")


def one_of(x: str, values) -> str:
    return f"({x} in ({', '.join(repr(v) for v in values)}))"


def any_in(x: str, parts) -> str:
    return "(" + " or ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def ends(x: str, *tails: str) -> str:
    return "(" + " or ".join(f"right({x}, {len(t)}) = '{t}'" for t in tails) + ")"


def begins(x: str, *heads: str) -> str:
    return "(" + " or ".join(f"left({x}, {len(h)}) = '{h}'" for h in heads) + ")"


def lines(d: Spark, x: str) -> str:
    """The lines without their ends; no empty last one."""
    if d.name == "spark":
        # One pass over the text; the empty piece after a last line end is dropped.
        return f"transform(array({d.split(x, NEWLINE)}), z -> case when size(z) > 1 and element_at(z, -1) = '' then slice(z, 1, size(z) - 1) else z end)[0]"
    return d.split(d.sub(x, rf"(?:{NEWLINE})$", ""), NEWLINE)


def standing(d: Spark, x: str, words: tuple[str, ...], rest: str, flags: str = "") -> str:
    """Whether one of the words stands in x, no word character before it, and ``rest`` follows.

    For Spark the word comes first in the pattern and what is before it is looked at last, so that a long text is passed by comparing
    one character at each place; the checking engine has no such look back.
    """
    one = "|".join(words)
    group = f"(?:{one})" if len(words) > 1 else one
    if d.name == "spark":
        return d.match(x, rf"{flags}{group}(?<!{WORD}{group}){rest}")
    return d.match(x, rf"{flags}(?:^|[^\p{{L}}\p{{N}}_]){group}{rest}")


def at_line(d: Spark) -> str:
    """What begins a line, before a pattern whose first character is no white space.

    In Spark's pattern it stays within that line: one that may span lines looks at n blank ones n * n / 2 times, and finds no more.
    """
    return r"^[ \t\x0B\f\r]*" if d.name == "spark" else r"^\s*"


def holding(d: Spark, x: str, part: str, found: str) -> str:
    """``found``, an array of texts; empty where x does not hold what every one of them needs."""
    return f"case when not contains({x}, '{part}') then {d.no_texts()} else {found} end" if d.name == "spark" else found


def line_count(d: Spark, x: str) -> str:
    """Newline bytes, one more if text follows the last."""
    if d.name == "spark":
        return f"cast(octet_length({x}) - octet_length(replace({x}, chr(10), '')) + case when {x} = '' or right({x}, 1) = chr(10) then 0 else 1 end as bigint)"
    return f"cast(length({x}) - length(replace({x}, chr(10), '')) + case when {x} = '' or right({x}, 1) = chr(10) then 0 else 1 end as bigint)"


def name(path: str) -> str:
    return f"split_part({path}, '/', -1)"


def suffix(d: Spark, path: str) -> str:
    """With its dot; empty for names without one or with a leading dot only."""
    return d.extract(name(path), r"[^.].*?(\.[^.]+)$")


def stem(d: Spark, path: str) -> str:
    return d.sub(name(path), r"^(.+)\.[^.]+$", "$1")


def extension(d: Spark, path: str) -> str:
    return f"coalesce(nullif(lower({suffix(d, path)}), ''), {name(path)})"


def has_marker(x: str) -> str:
    return any_in(f"lower({x})", ("todo", "fixme", "hack", "xxx"))


def todo_count(d: Spark, rows: str) -> str:
    """``rows``: the lines."""
    marker = standing(d, "l", ("TODO", "FIXME", "HACK", "XXX"), r"\s*[:(-]", "(?i)")
    if d.name == "spark":
        marker = f"{has_marker('l')} and {marker}"
    return f"{d.size(d.filter(rows, 'l', f'{marker} and not {any_in("lower(l)", NOT_MARKERS)}'))}"


def has_main(d: Spark, x: str, ext: str) -> str:
    starts = lambda s: d.match(x, rf"{d.multiline}{at_line(d)}{s} main\(")
    held = f"contains({x}, 'main') and " if d.name == "spark" else ""
    guard = f"contains({x}, 'if __name__ == \"__main__\"') or contains({x}, {d.lit("if __name__ == '__main__'")})"
    return f"""(case when {ext} = '.py' then {guard}
      when {ext} in ('.js', '.ts') then contains({x}, 'require.main === module') or contains({x}, 'process.argv')
      when {ext} in ('.sh', '.bash') then left({x}, 2) = '#!' or contains({x}, 'main()')
      when {ext} in ('.cpp', '.c', '.cc', '.cxx') then {held}{d.match(x, r'(?:^|[^\p{L}\p{N}_])(?:int|auto|void)\s+main\s*\(')}
      when {ext} = '.go' then {starts('func')} when {ext} = '.rs' then {starts('fn')} else false end)"""


def has_class(d: Spark, x: str) -> str:
    held = f"contains({x}, 'class') and " if d.name == "spark" else ""
    return f"({held}{standing(d, x, ('class',), rf'\s+{WORD}+')})" if held else standing(d, x, ("class",), rf"\s+{WORD}+")


def has_function(d: Spark, x: str) -> str:
    if d.name == "spark":
        return "(" + " or ".join(f"contains({x}, '{w}') and {standing(d, x, (w,), rest)}" for w, rest in (("def", rf"\s+{WORD}+"), ("function", rf"\s+{WORD}+"), ("const", rf"\s+{WORD}+\s*=\s*\("))) + ")"
    b = r"(?:^|[^\p{L}\p{N}_])"
    return d.match(x, rf"{b}def\s+{WORD}+|{b}function\s+{WORD}+|{b}const\s+{WORD}+\s*=\s*\(")


def imports(d: Spark, x: str, ext: str) -> str:
    m, every = d.multiline, lambda p, g=1: d.extract_all(x, p, g)
    a = at_line(d)
    found = f"""(case when {ext} = '.py' then {holding(d, x, "import", d.concat(every(rf"{m}{a}import\s+([\p{{L}}\p{{N}}_.]+)"), every(rf"{m}{a}from\s+([\p{{L}}\p{{N}}_.]+)\s+import")))}
      when {ext} in ('.js', '.ts') then {d.concat(every(rf'''{m}{a}import(?:.+from\s+)?["']([^"']+)["']'''.replace("'", chr(92) + "x27").replace('"', chr(92) + "x22")), every(r"require\(\s*[\x22\x27]([^\x22\x27]+)[\x22\x27]\s*\)"))}
      when {one_of(ext, C_FAMILY)} then {holding(d, x, "#include", every(rf"{m}{a}#include\s*[<\x22]([^>\x22]+)[>\x22]"))}
      when {ext} = '.go' then {holding(d, x, "import", d.concat(every(rf"{m}{a}import\s+[\x22\x27]([^\x22\x27]+)[\x22\x27]"), every(rf"{m}^\s*import\s*\(\s*$", 0)))}
      when {ext} = '.rs' then {every(rf"{m}{a}use\s+([A-Za-z0-9_:]+)")} else {d.no_texts()} end)"""
    return d.slice(d.distinct(found), 20)


def symbols(d: Spark, x: str, ext: str) -> str:
    m, every = d.multiline, lambda p: d.extract_all(x, p, 1)
    # Runs of words as one character class: a repeated group would recurse once for each word of a long text.
    run, a = r"[\p{L}\p{N}_][\p{L}\p{N}_\s]*\s", at_line(d)
    owner, called = rf"\s*(?:{run})?({WORD}+)::{WORD}*\s*\(", rf"\s*{run}({WORD}+)\s*\("

    def each(p: str, end: str) -> str:
        """What p finds at a line's beginning, which ``end`` follows.

        Where p fails, it fails at all lines that begin within the same words and spaces: for Spark these are passed as a match without
        a name, so that each is looked at once and not from each of its lines again.
        """
        if d.name != "spark":
            return every(rf"{m}^{p}")
        words = r"[\p{L}\p{N}_\s]++"
        return holding(d, x, end, d.filter(every(rf"{m}^(?:(?={words}{end.replace('(', chr(92) + '(')}){p}|{words})"), "s", "s <> ''"))

    c = d.concat(each(owner, "::"), each(called, "("), holding(d, x, "class", every(rf"{m}{a}class\s+({WORD}+)")))
    found = f"""(case when {ext} = '.py' then {every(rf"{m}{a}(?:async\s+def|def|class)\s+([A-Za-z_][A-Za-z0-9_]*)")}
      when {ext} in ('.js', '.ts') then {every(rf"{m}{a}(?:export\s+)?(?:async\s+)?(?:function|class|const|let|var)\s+([A-Za-z_$][A-Za-z0-9_$]*)")}
      when {ext} = '.go' then {every(rf"{m}{a}(?:func|type|struct|interface)\s+([A-Za-z_][A-Za-z0-9_]*)")}
      when {one_of(ext, C_FAMILY)} then {c}
      when {ext} = '.rs' then {every(rf"{m}{a}(?:pub\s+)?(?:async\s+)?(?:fn|struct|enum|trait)\s+([A-Za-z_][A-Za-z0-9_]*)")}
      else {d.no_texts()} end)"""
    return d.slice(d.distinct(found), 8)


def manifest(d: Spark, x: str, ext: str, base: str, key: str) -> str:
    """The name or description that a manifest gives, null if none."""
    m, q = d.multiline, r"[\x22\x27]([^\x22\x27]+)[\x22\x27]"
    extra = ""
    if key == "name":
        extra = f"""when {base} = 'go.mod' then {d.extract(x, rf'{m}^module\s+(\S+)')}
          when {base} = 'cmakelists.txt' then {d.extract(x, r'(?i)project\s*\(\s*([A-Za-z0-9_-]+)')}"""
    return f"""nullif(trim(case when {ext} = '.toml' then {d.extract(x, rf'{m}{at_line(d)}{key}\s*=\s*{q}')}
      when {ext} = '.json' then {d.extract(x, rf'\x22{key}\x22\s*:\s*\x22([^\x22]+)\x22')}
      when {base} = 'setup.py' then {d.extract(x, rf'{key}\s*=\s*{q}')} {extra} else '' end), '')"""


def is_document(ext: str, base: str) -> str:
    return f"({ext} in ('.md', '.txt') or {base} in ('readme.md', 'readme.txt', 'readme'))"


def doc_title(d: Spark, x: str) -> str:
    return f"nullif(left(trim({d.extract(x, rf'{d.multiline}{at_line(d)}#{{1,6}}\s+(.+)$')}), 160), '')"


def drift_flags(d: Spark, x: str) -> str:
    """Labels of the placeholder patterns that occur."""
    held = lambda p: f"contains(lower({x}), '{PLACEHOLDER_PARTS[p]}') and " if d.name == "spark" else ""
    hits = [f"case when {held(p)}{d.match(f'lower({x})', d.multiline + (at_line(d) + p[4:] if p.startswith(r'^\s*') else p))} then '{label}' end" for p, label in PLACEHOLDERS]
    return d.slice(d.filter(d.array(*hits), "h", "h is not null"), 6)


def drift_lines(d: Spark, text: str, x: str) -> str:
    """``text``: the lines of ``x``. Of the first three placeholder patterns that occur: label, number and beginning of their first line."""

    def first(p: str, label: str) -> str:
        i = d.at(d.filter(d.sequence("1", d.size(text)), "i", d.match(f"lower({d.at(text, 'cast(i as int)')})", p)), "1")
        said = f"'{label} at ' || {d.text(i)} || ': ' || left(trim({d.at(text, f'cast({i} as int)')}), 100)"
        return f"case when contains(lower({x}), '{PLACEHOLDER_PARTS[p]}') then {said} end" if d.name == "spark" else said

    return d.slice(d.filter(d.array(*[first(p, label) for p, label in PLACEHOLDERS]), "h", "h is not null"), 3)


def empty_headings(d: Spark, text: str) -> str:
    """``text``: the lines. Headings none of whose next four lines has text, or whose next text is a bare list mark; the last line is never tested."""
    after = d.filter(d.cut(text, "i + 1", "i + 4"), "c", "trim(c) <> ''")
    first = f"coalesce(trim({d.at(after, '1')}), '')"
    return d.size(d.filter(d.sequence("1", f"{d.size(text)} - 1"), "i", f"left(trim({d.at(text, d_int(d, 'i'))}), 1) = '#' and {first} in ('', '-', '1.', '2.', '3.')"))


def d_int(d: Spark, x: str) -> str:
    return f"cast({x} as int)"


def strip_html(d: Spark, x: str) -> str:
    return f"trim({d.sub(x, '<[^>]*>', '')})"


LINK = r"\[([^\]]+)\]\([^)]+\)"


def strip_markdown(d: Spark, x: str) -> str:
    return f"trim(replace(replace(replace({d.sub(x, LINK, '$1')}, '*', ''), '_', ''), '`', ''))"


def clean_links(d: Spark, x: str) -> str:
    """Link texts without their targets, broken links too."""
    return d.sub(d.sub(x, LINK, "$1"), r"\[([^\]]*)\]\([^)]*\)?", "$1")


def plain_text(d: Spark, x: str) -> str:
    """Without tags, link targets, image sources and addresses."""
    y = clean_links(d, d.sub(f"trim({x})", "<[^>]*>", ""))
    return f"trim({d.sub(d.sub(d.sub(y, r'src=\x22[^\x22]*\x22', ''), r'src=\x27[^\x27]*\x27', ''), r'https?://[^\s]+', '')})"


# Texts that name or describe nothing, headings of sections, words that no project's title has.
FILLER = ("application logic, application logic", "application logic.", "application logic and", "it is organized around application logic", "appears to be c++ project and a test suite", "appears to be c++ project")
HEADINGS = (
    "install", "installation", "getting started", "quickstart", "quick start", "usage", "api", "api reference", "overview", "introduction", "contributing",
    "contributor", "license", "licensing", "documentation", "references", "resources", "support", "roadmap", "changelog", "release notes", "faq", "architecture",
    "design", "configuration", "setup", "development", "building", "build", "testing", "deploy", "sponsor", "sponsors", "sponsorship", "funding", "donate", "why",
    "why?", "getting help", "help", "features", "requirements", "prerequisites", "dependencies", "screenshots", "showcase",
)
TITLE_WORDS = (
    "sponsor", "sponsors", "sponsorship", "funding", "donate", "donation", "badge", "badges", "coverage", "downloads", "why", "why?", "installation", "contributing",
    "documentation", "overview", "introduction", "license", "licensing", "changelog", "roadmap", "support", "usage", "api", "faq", "help", "community",
)


def bad_identity(d: Spark, x: str) -> str:
    """Whether a text cannot name or describe a project: empty, markup, badges, tables, section headings, decoration."""
    v = f"lower(trim({x}))"
    marks = r"^<|^!\[|^\[!\[|^`(.*`)?$|align=[\x22\x27]center[\x22\x27]|src=[\x22\x27]http|raw\.githubusercontent\.com|shields\.io|travis-ci\.|github-ci|codecov|^[-_=~*#.]+$"
    return f"""(coalesce(trim({x}), '') = '' or {d.match(v, marks)} or contains({x}, '|') and {d.match(v, r'--|\*\*|\[')} or contains({v}, 'badge') and (contains({v}, '.svg') or contains({v}, '.png'))
      or {any_in(v, FILLER)} or {one_of(v, HEADINGS)})"""


def valid_title(d: Spark, x: str) -> str:
    """Whether a README's title may name the project."""
    v = f"lower(trim({x}))"
    words = d.split(v, r"\s+")
    return f"""(length(trim({x})) >= 2 and not {bad_identity(d, x)} and not {d.match(v, r'align=|src=|badge|shield|sponsor|funding|donate|\?|^(why|what|how|who|where|when) ')}
      and {d.size(words)} <= 6 and {d.size(d.filter(words, 'w', one_of('w', TITLE_WORDS)))} = 0)"""


def summary(d: Spark, ext: str, base: str, x: str, after: str, both: str) -> str:
    """A document's first real line after a heading (``after``: the lines there), a docstring's first line, or ``both``, what a manifest says."""
    plain = f"trim({clean_links(d, 'trim(l)')})"
    good = f"""trim(l) <> '' and left(trim(l), 1) <> '#' and left(trim(l), 2) <> '[!' and trim(l) <> '```' and (length(trim(l)) >= 15 or right(trim(l), 1) = '.') and not {bad_identity(d, 'l')} and {plain} <> ''"""
    line = f"left({clean_links(d, f'trim({d.at(d.filter(after, "l", good), "1")})')}, 160)"
    quoted = f"({any_in(x, (chr(34) * 3,))} or contains({x}, {d.lit(chr(39) * 3)})) and " if d.name == "spark" else ""
    doc = d.extract(x, r"(?s)^\s*(?:\x22\x22\x22|\x27\x27\x27)\s*(.+?)\s*(?:\x22\x22\x22|\x27\x27\x27)")
    return f"""coalesce(case when {ext} in ('.md', '.txt') then {line} when {ext} = '.py' and {quoted}{doc} <> '' then left({d.at(d.split(f'trim({doc})', NEWLINE), '1')}, 160)
      when {ext} in ('.toml', '.json') or {base} = 'setup.py' then left({both}, 160) end, '')"""


def tokens(d: Spark, x: str) -> str:
    """Estimated tokens: a quarter of the characters, rounded up; 0 for blank."""
    return f"(case when trim({x}) = '' then 0 else greatest(1, {d.div(f'length(trim({x})) + 3', '4')}) end)"


def module_name(d: Spark, path: str) -> str:
    parts = d.split(d.sub(path, r"\.[^./]+$", ""), "/")
    return d.join(d.filter(parts, "p", "p <> '__init__'"), ".")


def term_score(d: Spark, hay: str, term: str) -> str:
    """4 for a whole word, 1 inside one, 0 if absent; terms are ASCII letters, digits and underscores."""
    whole = d.match(hay, rf"(?:^|[^\p{{L}}\p{{N}}_]){term}(?:$|[^\p{{L}}\p{{N}}_])")
    return f"(case when {whole} then 4 when contains({hay}, '{term}') then 1 else 0 end)"
