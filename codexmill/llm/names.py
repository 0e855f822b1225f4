"""Variant spellings of names (problem 2): parsing and comparison of typed names. The resolution is in ``entities``."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

# Given names with their short and pet forms.
GIVEN_FORMS = {
    "alexandra": ("alex", "sasha", "sandra"),
    "alexander": ("alec", "alexr"),
    "andrew": ("andy", "andw"),
    "antonia": ("ant", "toni"),
    "anthony": ("tony", "anth"),
    "bartholomew": ("bart", "barth"),
    "benjamin": ("ben", "benj"),
    "catherine": ("cath", "cathy"),
    "charles": ("chas", "chuck", "charlie"),
    "christopher": ("chris", "chr"),
    "daniel": ("dan", "danny"),
    "david": ("dave", "dav"),
    "dorothea": ("dor", "dora"),
    "edward": ("edw", "eddie"),
    "elizabeth": ("eliz", "liz", "betty"),
    "francis": ("fran", "frank"),
    "frederick": ("fred", "fritz"),
    "gabriele": ("gabr", "gabi"),
    "george": ("geo", "georgie"),
    "giuseppe": ("gius", "beppe"),
    "heinrich": ("hnr", "heinz"),
    "henry": ("hal", "harry"),
    "isabella": ("isa", "isab"),
    "james": ("jas", "jim"),
    "johanna": ("joh", "hanna"),
    "john": ("jno", "jack"),
    "jonathan": ("jon", "jona"),
    "joseph": ("jos", "joe"),
    "katherine": ("kath", "kate"),
    "leonardo": ("leon", "leo"),
    "margaret": ("marg", "peggy"),
    "matthew": ("matt", "matth"),
    "michael": ("mich", "mike"),
    "nicholas": ("nich", "nick"),
    "ottilie": ("ott", "otti"),
    "patricia": ("patr", "trish"),
    "richard": ("rich", "dick"),
    "robert": ("robt", "bob"),
    "samuel": ("saml", "sam"),
    "stephanie": ("steph", "steffi"),
    "susan": ("sus", "sue"),
    "theodore": ("theo", "ted"),
    "thomas": ("thos", "tom"),
    "ulrich": ("ulr", "ulli"),
    "victoria": ("vict", "vicky"),
    "william": ("wm", "bill"),
    "yolanda": ("yol", "yola"),
    "zacharias": ("zach", "zacharie"),
}
# Words around a name that are no part of it.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "du", "la", "le", "zu", "zur", "ter", "ten", "af")
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "sir", "herr", "frau", "rev", "phd", "jr", "sr", "esq")
PLACEHOLDERS = ("anonymous", "anon", "unknown", "unknown author", "unknown publisher", "author unknown", "various", "various authors", "na", "none", "null", "nn", "sn", "tba", "tbd", "not available", "no author", "see notes", "self published", "et al")
# Words of houses in their short forms and legal forms.
HOUSE_FORMS = {
    "books": ("books", "bks", "book"),
    "editions": ("editions", "edns", "eds", "ed", "edn", "edition"),
    "press": ("press", "pr", "prs"),
    "publishing": ("publishing", "publ", "pub", "publishers", "publisher"),
    "university": ("university", "univ", "u"),
    "verlag": ("verlag", "verl", "vlg", "vg"),
    "sons": ("sons",),
}
HOUSE_NOISE = ("the", "and", "of", "limited", "ltd", "inc", "incorporated", "company", "co", "gmbh", "llc", "ag", "sa", "plc", "cie", "p")

_FORM_OF = {f: g for g, fs in GIVEN_FORMS.items() for f in (g, *fs)}
_HOUSE_OF = {f: g for g, fs in HOUSE_FORMS.items() for f in fs}
_NOTE = re.compile(r"\s*[(\[][^)\]]*[)\]]\s*")
_WORD = re.compile(r"[^\W\d_]+(?:[-'][^\W\d_]+)*", re.UNICODE)


def folded(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))


def near(a: str, b: str) -> bool:
    """At most one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if abs(la - lb) > 1:
        return False
    i = 0
    while i < min(la, lb) and a[i] == b[i]:
        i += 1
    if la == lb:
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if la > lb else a[i:] == b[i + 1 :]


@lru_cache(1 << 16)
def given_names(token: str) -> tuple[str, ...]:
    """The full given names that a token can mean; one slip of the pen is forgiven in longer ones."""
    if token in _FORM_OF:
        return (_FORM_OF[token],)
    hits = {f: g for f, g in _FORM_OF.items() if len(f) >= 4 and near(f, token)} if len(token) >= 4 else {}
    same = {g for f, g in hits.items() if f[0] == token[0]}  # slips seldom touch the first letter
    return tuple(sorted(same or set(hits.values())))


def _stem(name: str) -> str:
    """What a pet form keeps of its name (Jenny: jenn, Danny: dan), the empty string where it keeps too little."""
    bare = re.sub(r"(?:ie|ey|ee|y|i)$", "", name)
    if bare == name:
        return ""
    if len(bare) >= 3 and bare[-1] == bare[-2] and bare[-1] not in "aeiou" and name[-1] != "i":
        return bare[:-1] if len(bare) == 4 else bare
    return bare if len(bare) >= 4 else ""


def shortens(short: str, long: str) -> bool:
    """Whether a given name may be an abbreviation or a pet form of a longer one.

    A vowel more at the end makes another name (Martin, Martina).
    """
    if short == long or len(short) >= len(long) + 2:
        return False
    if long.startswith(short):
        return len(short) >= 2 and (len(long) - len(short) > 1 or long[-1] not in "aeio")
    stem = _stem(short)
    return bool(stem) and long.startswith(stem) and len(long) >= len(stem) + 3


def one_given(a: str, b: str) -> bool:
    """Whether two given names, not both of the table, may be one: a slip of the pen, an abbreviation or a pet form.

    A last letter that differs makes another name; so does one other letter in a short name (Maria, Marta) or at the front
    of one that is not long (Darlene, Marlene).
    """
    if a in GIVEN_FORMS and b in GIVEN_FORMS:
        return False
    short, long = sorted((a, b), key=len)
    if long.startswith(short):
        return shortens(short, long)
    if shortens(short, long) or shortens(long, short):
        return True
    if not near(a, b):
        return False
    if sorted(a) == sorted(b):
        return len(a) >= 4
    return len(short) >= (6 if a[0] == b[0] else 8) and a[-1] == b[-1]


def slip_keys(name: str) -> set[str]:
    """Keys of which two names one slip of the pen apart share at least one."""
    keys = {"-" + name}
    for i in range(len(name)):
        keys |= {name[:i] + "?" + name[i + 1 :], "-" + name[:i] + name[i + 1 :]}
        if i + 1 < len(name):
            keys.add(name[:i] + "~" + "".join(sorted(name[i : i + 2])) + name[i + 2 :])
    return keys


def called(names: list[str]) -> dict[str, str]:
    """What each given name or initial of a block is called: slips, pet forms and abbreviations by the name they mean, if they mean only one.

    Names are looked up by their slip keys and beginnings, so that a block of many names takes a time in proportion.
    """
    order = sorted(set(names), key=lambda n: (-len(n), n))
    ranked = sorted(order)

    def meanings(n: str) -> Iterator[str]:
        """Names that n may shorten."""
        for head in {n, _stem(n)} - {""}:
            at = bisect_left(ranked, head)
            while at < len(ranked) and ranked[at].startswith(head):
                m = ranked[at]
                if m != n and (shortens(n, m) if len(n) > 1 else len(m) > 1) and not (n in GIVEN_FORMS and m in GIVEN_FORMS):
                    yield m
                at += 1

    of: dict[str, str] = {}
    held: dict[str, list[str]] = {}  # members of each name
    by_key: dict[str, list[str]] = {}
    shorts = {n for n in order if next(meanings(n), None) is not None}
    for n in order:
        if n in shorts:
            continue
        keys = slip_keys(n)
        likes = {of[m] for k in keys for m in by_key.get(k, ()) if one_given(n, m)}
        for k in keys:
            by_key.setdefault(k, []).append(n)
        listed = sorted(x for x in likes if x in GIVEN_FORMS)
        if len(listed) > 1 or (listed and n in GIVEN_FORMS):  # names of the table stay apart
            likes = set()
        head = n if n in GIVEN_FORMS else (listed or sorted(likes) or [n])[0]
        group = [n, *(m for x in likes for m in held.pop(x, ()))]
        held.setdefault(head, []).extend(group)
        of |= dict.fromkeys(group, head)
    for n in sorted(shorts, key=lambda n: (-len(n), n)):
        meant: set[str] = set()
        for m in meanings(n):
            if m in of:
                meant.add(of[m])
            if len(meant) > 1:
                break
        of[n] = meant.pop() if len(meant) == 1 else n
    return of


def _house_word(token: str) -> str:
    """The word of a house that a token means: a form, the noise word itself, or the empty string."""
    if token in _HOUSE_OF:
        return _HOUSE_OF[token]
    if token in HOUSE_NOISE:
        return token
    hits = {g for f, g in _HOUSE_OF.items() if len(f) >= 5 and near(f, token)} | {f for f in HOUSE_NOISE if len(f) >= 5 and near(f, token)} if len(token) >= 4 else set()
    return hits.pop() if len(hits) == 1 else ""


def is_placeholder(text: str) -> bool:
    words = " ".join(_WORD.findall(folded(_NOTE.sub(" ", text))))
    return words == "" or words in PLACEHOLDERS or re.sub(r"[^a-z]", "", words) in PLACEHOLDERS


def parse_person(text: str) -> dict | None:
    """surname (with particles first), given (full, if known), initial, middle; None for placeholders.

    Of two or more words without a comma, an initial or a given name of the table either end may be the family name: other
    is then the second reading (surname, given), else None.
    """
    if is_placeholder(text):
        return None
    bare = folded(_NOTE.sub(" ", text))
    bare = re.sub(r"\bph\.? ?d\b\.?", " ", bare).strip(" ,")
    left, comma, right = bare.partition(",")
    words = lambda s: [w for w in _WORD.findall(s) if w not in TITLES]
    a, b = words(left), words(right)
    particles = [w for w in a + b if w in PARTICLES]
    a, b = [w for w in a if w not in PARTICLES], [w for w in b if w not in PARTICLES]
    other = None
    if comma and a and b:
        surname, given = a, b
    else:
        t = a + b
        if not t:
            return None
        if len(t) == 1:
            surname, given = t, []
        else:
            first, last = len(t[0]) == 1 or given_names(t[0]), len(t[-1]) == 1 or given_names(t[-1])
            if first:
                cut = 1
                while cut < len(t) - 1 and len(t[cut]) == 1:
                    cut += 1
                given, surname = t[:cut], t[cut:]
            elif len(t[-1]) == 1 and len(t) > 2 and given_names(t[-2]):
                given, surname = t[-2:], t[:-2]
            elif last:
                given, surname = t[-1:], t[:-1]
            else:
                given, surname = t[:1], t[1:]
                while len(surname) > 1 and len(surname[0]) == 1:
                    given.append(surname.pop(0))
                if not particles and all(len(w) > 1 for w in t):
                    other = (" ".join(t[:-1]), t[-1])
    full = [w for w in given if len(w) > 1]
    meant = given_names(full[0]) if full else ()
    name = meant[0] if len(meant) == 1 else "" if meant or not full else full[0]
    initials = [w[0] for w in given]
    middle = ""
    if full and len(initials) > 1:
        middle = next((w[0] for w in given if w is not full[0]), "")
    elif len(initials) > 1:
        middle = initials[1]
    return {"surname": " ".join([*particles, " ".join(surname)]).strip(), "given": name, "initial": name[:1] or (meant or full or initials or [""])[0][:1], "middle": middle, "other": other}


def parse_house(text: str) -> dict | None:
    """stem (the distinctive words) and form (kind of house, if told); None for placeholders."""
    if is_placeholder(text):
        return None
    words = re.sub(r"\b([a-z])\.(?=[a-z]\b)", r"\1", folded(_NOTE.sub(" ", text)))
    tokens = [w for w in _WORD.findall(words.replace("g.m.b.h", "gmbh").replace("gmb.h", "gmbh"))]
    meant = [_house_word(w) for w in tokens]
    forms = {m for m in meant if m in HOUSE_FORMS} | ({"university", "press"} if "up" in tokens else set())
    stem = [w for w, m in zip(tokens, meant, strict=True) if not m and w not in ("up", "gmbh")]
    return {"stem": " ".join(stem) or " ".join(tokens), "form": " ".join(sorted(forms))}
