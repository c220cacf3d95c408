"""Compiles the matching lexicon from its four YAML layouts.

Reads the plain subset of YAML that these files use: nested keys, lists and inline lists.
Entries that aren't fully ASCII are left out, and a one-letter word is never stripped, so dotted
legal forms leave no fragments behind.
"""

from __future__ import annotations

import re
from pathlib import Path

from partyloom.functions.text import Lexicon

#: Titles that are also names or words of names.
NOT_TITLES = frozenset({"DE", "LA", "EL", "AL", "BIN", "VAN", "VON"})


def _scalar(s: str):
    s = s.strip()
    if len(s) > 1 and s[0] == s[-1] and s[0] in "'\"":
        return s[1:-1]
    if s.startswith("[") and s.endswith("]"):
        return [_scalar(x) for x in re.split(r",(?=(?:[^'\"]*['\"][^'\"]*['\"])*[^'\"]*$)", s[1:-1]) if x.strip()]
    return s


def parse_yaml(text: str):
    """Maps, lists and scalars by indentation."""
    lines = []
    for raw in text.splitlines():
        bare = raw.rstrip()
        if bare.strip() and not bare.lstrip().startswith("#"):
            bare = re.sub(r"\s+#[^'\"]*$", "", bare)
            lines.append((len(bare) - len(bare.lstrip()), bare.strip()))

    def block(i: int, indent: int):
        if lines[i][1].startswith("- ") or lines[i][1] == "-":
            out = []
            while i < len(lines) and lines[i][0] == indent and lines[i][1].startswith("-"):
                rest = lines[i][1][1:].strip()
                if re.match(r"^[\w.'\" -]+:(\s|$)", rest):
                    lines[i] = (indent + 2, rest)
                    item, i = block(i, indent + 2)
                    out.append(item)
                elif rest:
                    out.append(_scalar(rest))
                    i += 1
                else:
                    item, i = block(i + 1, lines[i + 1][0])
                    out.append(item)
            return out, i
        out = {}
        while i < len(lines) and lines[i][0] == indent and ":" in lines[i][1] and not lines[i][1].startswith("- "):
            key, _, rest = lines[i][1].partition(":")
            key, i = _scalar(key), i + 1
            if rest.strip():
                out[key] = _scalar(rest)
            elif i < len(lines) and (lines[i][0] > indent or (lines[i][0] == indent and lines[i][1].startswith("-"))):
                out[key], i = block(i, lines[i][0])
            else:
                out[key] = []
        return out, i

    return block(0, lines[0][0])[0] if lines else {}


def _words(s) -> list[str]:
    s = str(s).upper()
    return re.sub(r"[^A-Z0-9]+", " ", s.replace(".", "")).split() if s.isascii() else []


def compile_lexicon(folder: str | Path) -> Lexicon:
    """From symbols.yml, org_types.yml, stopwords.yml and compare.yml in `folder`."""
    load = lambda name: parse_yaml((Path(folder) / name).read_text(encoding="utf-8")) if (Path(folder) / name).exists() else {}
    symbols, types, stop, compare = (load(f"{n}.yml") for n in ("symbols", "org_types", "stopwords", "compare"))
    strip: set[str] = set()
    for key, forms in (symbols.get("org_symbols") or {}).items():
        for form in [key, *(forms or [])]:
            strip.update(_words(form))
    for row in types.get("types") or []:
        for form in [row.get("display"), row.get("generic"), row.get("compare"), *(row.get("aliases") or [])]:
            if form:
                strip.update(_words(form))
    canon = {}
    for key, forms in (symbols.get("org_domains") or {}).items():
        main = _words(key)
        if len(main) == 1:
            canon |= {w[0]: main[0] for f in forms or [] if len(w := _words(f)) == 1 and w[0] != main[0]}
    for k in ("ORG_NAME_PREFIXES", "OBJ_NAME_PREFIXES"):
        for form in stop.get(k) or []:
            strip.update(_words(form))
    titles = {tuple(w) for form in stop.get("PERSON_NAME_PREFIXES") or [] if (w := _words(form)) and not NOT_TITLES & set(w)}
    pairs = {tuple(map(str, p)) for p in compare.get("similar_pairs") or [] if len(p) == 2}
    strip = {w for w in strip if len(w) > 1} - set(canon)
    return Lexicon(frozenset(strip), canon, tuple(sorted(titles, key=lambda t: (-len(t), t))), frozenset(a + b for x, y in pairs for a, b in ((x, y), (y, x))))
