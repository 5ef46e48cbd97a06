"""Template residue and error-page text in commit records.

A record is taken apart into header, message, diff and, where something other
than a diff stands in the diff's or the whole text's place, the lines of that
page. Lines of diffs are never looked at. Numbers, hashes, addresses and dates
of every line are masked and equal masked lines are grouped across sources by
an exact hash, so each distinct line is judged once, however often it recurs,
and knows in how many records and sources it stands in place of a diff.

Lines are judged by structure and word classes, not by known sentences:

* a placeholder is a template's bracket whose content says nothing: any name in
  a mark only templates use, in other marks nothing but words of forms;
* an instruction is an imperative that speaks about the template itself or
  about the change still to be described;
* filler is a few words over and over, made-up Latin, keys at random, rows of
  dots, or a sentence that calls itself filler;
* a page line tells of a failure (a thing that is not found, not available,
  denied, expired ...), is an HTTP status, markup or an error object, or asks
  for scripts. Standing alone in place of the whole text it has to do so in
  full, in place of a diff a word is enough, and a line that recurs there in
  several records of several sources needs no words at all: no commit's own
  content does that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from http import HTTPStatus

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.plans.lookup import heavy_lookup_join
from gridloom.plans.materialize import materialize

#: A line in place of the diffs of so many records, from so many sources, belongs to a page. Two is the least that recurs at all, so the bar does not depend on the table's size.
RECURS = 2

# ---- fixed values: word classes in the languages of commit messages
_FIELD = frozenset(
    "title summary description ticket issue component module scope reviewer approver author email mail name date branch release version change changes commit type message test plan motivation reason subject "
    "context detail details body id number bug task feature topic text content value placeholder project team owner product link url reference cause impact risk milestone priority category label tag comment "
    "note sentence paragraph résumé titre texte contenu sujet motif descripción título asunto contenido texto cambio motivo titel betreff beschreibung kurzbeschreibung grund inhalt text 概要 説明 件名 описание заголовок".split()
)
_ASK = frozenset(
    "insert add fill in enter put type write provide specify choose select replace describe your my the a an of to for and or short one line brief here goes go required optional please this "
    "hier bitte einsetzen eintragen ergänzen ausfüllen ici à compléter remplir votre le la de du aquí completar rellenar su el del".split()
)
_ASK_CJK = re.compile("記入|入力|填写")
_IMPERATIVE = (
    r"(?:please|kindly|bitte|merci de|por favor)\b|(?:describe|explain|summari[sz]e|enter|write|insert|add|fill (?:in|out)|replace|put|keep|list|provide|state|specify|delete|remove|mention|tell|"
    r"d[ée]crivez|expliquez|remplacez|ajoutez|saisissez|supprimez|indiquez|escriba|describa|explique|reemplace|sustituya|borre|indique|beschreiben|ersetzen|опишите|замените|удалите)\b"
)
_ITSELF = (
    r"(?:this|these|the following|cette|cet|ce|esta|este|diese[nrs]?|эту|этот)\s+(?:hint|line|lines|text|comment|section|block|template|instruction|instructions|placeholder|question|note|paragraph|"
    r"ligne|texte|commentaire|línea|linea|texto|comentario|zeile|text|hinweis|abschnitt|строку|текст)\b|\blines like this\b"
)
_DISCARD = r"\b(?:delete|deleted|remove|removed|erase|supprime[zr]|effacez|borre|borrar|elimine|löschen|entfernen|удалите)\b"
_HANDING_IN = r"\b(?:before|when|once|after)\s+(?:you\s+|you're\s+)?(?:send|sending|merg|submit|commit|push|post|done|finish|filled|ready)\w*"
_THE_CHANGE = r"\b(?:your (?:change|commit|patch|work)s?|the (?:change|changes|commit|patch|purpose of this|reason for this)\b|this (?:change|commit|patch)|what (?:changed|was wrong|is wrong|you changed|you did|this)|why (?:it|this|you))"
_FILLER_NOUN = (
    r"(?:filler|fill-in|dummy|sample|example|placeholder|blind|mock|boilerplate)[ -]?(?:text|paragraph|message|sentence|content|copy|words?|description)s?|(?:text|words|something) to fill|fülltext|blindtext|platzhaltertext|"
    r"texte de remplissage|faux texte|texto de relleno|lorem ipsum|текст-заполнитель|ダミーテキスト"
)
_POINTS = r"(?:this|here|it|these|hier|dies|das|ceci|voici|c'est|est[oe]|aquí|это|some|just)\b"
_PROMISE = r"\b(?:goes here|will follow|to follow|to come|until|later|for now|your own words|real (?:content|text|description|message)|später|ersetzt|plus tard|más tarde|remplacer|sustituir)\b"
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_SCRIPT = r"(?:java ?scripts?|\bjs\b|ecmascript|\bscripts?\b|\bscripting\b)"
_SWITCH = (
    r"\b(?:enabl\w+|turn\w* (?:it )?o(?:n|ff)|switch\w* (?:it )?o(?:n|ff)|activat\w+|allow\w*|requir\w+|needs?|needed|must|disabled|block\w*|support\w*|does not run|without|only with|activez|activer|autorisez|active|activar|habilit\w+|requiere|"
    r"aktivier\w+|einschalten|erlauben|benötigt|erfordert|включит\w*|отключ\w*)\b|有効|無効|必要"
)
_ADDRESS = r"(?:\W*(?:please|you|your|this|we|to (?:view|use|see|load|continue|read)|bitte|pour|para|vous|votre|su|ihr\w*|activez|activer|autorisez|active|habilite|пожалуйста)\b|.*(?:を|してください)|" + _SCRIPT + r"\s+(?:is|are|has|must)\b)"
_THING = (
    r"\b(?:page|site|website|server|service|session|request|view|diff|commit|change|history|content|resource|file|document|repository|account|address|url|link|connection|gateway|permission|access|store|host|database|system|"
    r"seite|dienst|zugriff|sitzung|anfrage|inhalt|página|sitio|servicio|sesión|cambio|contenido|acceso|accès|service|serveur|demande|contenu|страниц\w*|сервер\w*|сервис\w*|доступ\w*|сайт\w*)\b|ページ|サーバー|サービス|アクセス"
)
_NOT = r"\b(?:not|no|never|cannot|\w+n't|unable to|failed to|nicht|kein\w*|ne|pas|não|не|нет)\b"
_GOOD_STATE = (
    r"\b(?:found|available|load\w*|reach\w*|respond\w*|answer\w*|display\w*|render\w*|process\w*|complet\w*|finish\w*|shown?|open\w*|permission|access\w*|authori[sz]ed|allowed|exist\w*|connect\w*|retriev\w*|fetch\w*|generat\w*|view|"
    r"gefunden|erreichbar|verfügbar|geladen|angezeigt|encontr\w+|cargar|disponible|mostrar|trouv\w+|affich\w+|accessible|найден\w*|доступ\w*|загруз\w*)\b"
)
_BAD_STATE = (
    r"\b(?:unavailable|unreachable|forbidden|denied|expired|unauthori[sz]ed|timed? ?out|timeout|overloaded|maintenance|went wrong|gone wrong|(?:has|have) ended|too (?:many|long)|moved permanently|temporarily|"
    r"introuvable|indisponible|refusé|expirée?|survenue|abgelaufen|verweigert|fehlgeschlagen|vorübergehend|denegado|caducad[oa]|salió mal|expirad[oa]|недоступ\w*|запрещ\w*|истек\w*)\b|見つかりません|利用できません|拒否|エラーが"
)
_ALARM = r"\b(?:error|erreur|fehler|ошибка|fatal|oops|whoops|sorry|problem|problème|exception|failure|attention|warning)\b|エラー|申し訳"
_MARKUP = r"</?(?:!doctype|html|head|title|body|center|hr|h#|noscript|meta|div|p)\b[^<>]*>.*"
_ERROR_OBJECT = r"[\[{].*[\"'](?:error|errors|status|code|message|exception|fault)[\"']\s*:.*[\]}]"
# ---- end of fixed values

_STATUS = "|".join(sorted(re.escape(s.phrase) for s in HTTPStatus if s >= 400))
_HTTP = re.compile(rf"(?:error:?\s+)?(?:http(?:/\S+)?\s+(?:error\s+)?#(?:\s.{{0,40}})?|(?:#\s*[-:]?\s*)?(?:{_STATUS})[.!]?)", re.I)
_FRAME = re.compile(f"{_MARKUP}|{_ERROR_OBJECT}", re.I | re.S)
_i = lambda p: re.compile(p, re.I)
_FAILS = _i(rf"{_NOT}.{{0,60}}?(?:{_GOOD_STATE})|{_BAD_STATE}|#\s*[-:]?\s*(?:{_STATUS})\b")
_HAS = {k: _i(v) for k, v in {"thing": _THING, "alarm": _ALARM, "script": _SCRIPT, "switch": _SWITCH, "address": _ADDRESS, "itself": _ITSELF, "discard": _DISCARD, "handing": _HANDING_IN, "change": _THE_CHANGE, "filler": _FILLER_NOUN, "promise": _PROMISE}.items()}
_STARTS = _i(rf"(?:\W|#)*(?:(?:todo|fixme|xxx)\b\W*)?(?:{_IMPERATIVE})")
_TELLS = _i(r"\W*(?:please\s+)?(?:describe|explain|summari[sz]e|tell|d[ée]crivez|expliquez|describa|explique|опишите)\b")
_YOURS = _i(r"\b(?:please|your|here|bitte|votre|ici|su|aquí|hier)\b")
# an order to remove what stands here ends there; one that goes on speaks of a change
_REMOVES = _i(rf"\W*{_DISCARD}\s+(?:(?:{_ITSELF})(?:\s+{_HANDING_IN}.*|\W*))?")
_TODO = _i(r"\W*(?:todo|fixme|xxx)\b\W")
_POINTING = _i(rf"\W*{_POINTS}")

_LABEL = r"(?:[*#•-]+\s+)?(?:[^\W\d_]+\s?:?\s+)?"
#: Marks of template languages, and marks that prose and code use as well.
_STRONG = [(r"\{\{-?", r"-?\}\}"), (r"\{%-?", r"-?%\}"), (r"<%[=-]?", r"-?%>"), (r"\$\{", r"\}"), (r"#\{", r"\}"), (r"%\(", r"\)s"), (r"\[\[", r"\]\]"), (r"<<", r">>"), ("@@", "@@"), ("&lt;", "&gt;")]
_WEAK = [("<", ">"), ("«", "»"), (r"\[", r"\]"), (r"\{", r"\}"), (r"\$", r"\$"), ("%", "%"), ("___", "___"), ("__", "__")]
_NAMED = r"\s*([^\W\d_](?:[\w .…()-]{0,60}?[\w.…)])?)\s*"
_MARK = re.compile("|".join(f"{a}{_NAMED}{b}" for a, b in _STRONG + _WEAK))
_SLOT = "\0"
_WHOLE = re.compile(rf"{_LABEL}{_SLOT}(?:\s+{_SLOT})*\.?|{_SLOT}:\s.+|.+\s(?:for\s+{_SLOT}|\({_SLOT}\))", re.S)
_PERSON = re.compile(rf"{_SLOT}(?:\s+<?.*>?)?|[^<>{_SLOT}]*<?{_SLOT}>?")
_WORD = re.compile(r"[A-ZÀ-Þ]?[^\W\d_A-ZÀ-Þ]+|[A-ZÀ-Þ]+(?![^\W\d_A-ZÀ-Þ])")
_MESH = re.compile(r"[asdfjklqwer]{2,}")
_ROW = re.compile(r"(?:x{2,}|X{2,}|\.{3,}|-{3,})")

_DIFF = re.compile(r"diff (?:--git|--cc|-r|--combined)\b|Index: |Binary files |GIT binary patch")
_STAT = re.compile(r"\s*\d+ files?(?:\(s\))? changed.*")
_ONE = re.compile(r"\* [0-9a-fA-F]{6,40} (.*)", re.S)
_ONE_TAIL = re.compile(r"(.*) \(([^()]*), [^(),]*\)", re.S)


def _says_nothing(content: str) -> bool:
    """Whether a bracket's content consists of words of forms, a field's name among them."""
    if _ASK_CJK.search(content):
        return True
    words = [w.lower() for w in _WORD.findall(content)]
    return any(w in _FIELD for w in words) and all(w in _FIELD or w in _ASK for w in words)


def _slots(line: str) -> str:
    """The line with each empty template bracket as one mark."""

    def one(m: re.Match) -> str:
        strong = m.lastindex <= len(_STRONG)
        return _SLOT if strong or _says_nothing(m[m.lastindex]) else m[0]

    return _MARK.sub(one, line)


def _instructs(line: str) -> bool:
    bare = re.sub(rf"^{_LABEL}(?=[A-ZÀ-Þ(<])", "", line, count=1)
    has = {k: bool(_HAS[k].search(bare)) for k in ("itself", "discard", "handing", "change")}
    asks = any(_STARTS.match(s) for s in (line, bare))
    if bare.startswith("<!--") and bare.endswith("-->"):
        return asks or has["discard"]
    if asks and has["itself"] and not (_REMOVES.match(bare) and not _REMOVES.fullmatch(bare)):
        return True
    if asks and (has["change"] and _TELLS.match(bare) or _YOURS.search(bare) and _says_nothing(bare)):
        return True
    if _TODO.match(bare) and has["handing"]:
        return True
    return has["discard"] and (has["itself"] and (";" in bare or "(" in bare) or has["handing"] and ("(" in bare or ";" in bare))


def _fills(line: str) -> bool:
    """Filler: a sentence that calls itself so, a sentence or a few words over and over, made-up Latin, keys hit at random, rows of x, dots and dashes."""
    words = line.split()
    low = [w.strip(".,;:!?").lower() for w in words]
    if len(words) >= 3 and sum(w in _LATIN for w in low) >= 0.8 * len(words):
        return True
    if _HAS["filler"].search(line) and (_POINTING.match(line) or _HAS["promise"].search(line)):
        return True
    spoken = [s.strip().lower() for s in re.split(r"[.!?]\s+", line.rstrip(".!?"))]
    if len(spoken) > 1 and len(words) >= 4 and any(a == b and " " in a for a, b in zip(spoken, spoken[1:])):
        return True
    if all(w.isalpha() for w in low) and (len(words) >= 5 and len(set(low)) <= 2 or len(words) >= 3 and len(set(low)) == 1):
        return True
    if len(words) >= 3 and all(_ROW.fullmatch(w) for w in words) and ("x" in line.lower() or len(words) >= 5):
        return True
    if len(words) >= 4 and all(_MESH.fullmatch(w) for w in words):
        return True
    return len(words) == 3 and all(_MESH.fullmatch(w) for w in words) and sum(not re.search("[ae]", w) or bool(re.search("[^ae]{3,}", w)) for w in words) >= len(words) / 3


def _page(line: str, alone: bool) -> bool:
    """Whether a line belongs to an error page or a notice about scripts; ``alone``: nothing tells that it stands where a diff should be."""
    if _HTTP.fullmatch(line) or _FRAME.fullmatch(line):
        return True
    if _HAS["script"].search(line) and _HAS["switch"].search(line) and (not alone or _HAS["address"].match(line)):
        return True
    if _FAILS.search(line):
        return not alone or bool(_HAS["thing"].search(line) or _HAS["alarm"].search(line))
    return not alone and bool(_HAS["alarm"].search(line))


def _verdict(role: str, line: str, records: int, sources: int) -> str | None:
    """Why a distinct masked line makes its records cases, or null; ``records`` and ``sources`` are those where it stands in place of a diff."""
    if role == "header":
        return "placeholder" if _PERSON.fullmatch(_slots(line)) else None
    if role == "message":
        if _WHOLE.fullmatch(_slots(line)):
            return "placeholder"
        if _instructs(line):
            return "instruction"
        return "filler" if _fills(line) else None
    if records >= RECURS and sources >= RECURS:
        return "recurring page"
    return "page" if _page(line, role != "page") else None


_MASKS = [(re.compile(r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "E"), (re.compile(r"\b[0-9a-f]{7,}\b"), "#"), (re.compile(r"\d+(?:[-:/.,]\d+)*"), "#")]


def _mask(line: str) -> str:
    for p, by in _MASKS:
        line = p.sub(by, line)
    return " ".join(line.split())


def _units(text: str) -> Iterator[tuple[str, str]]:
    """(role, line) of header, message and page lines. A page line stands in place of a diff; ``tail`` is for lines of which the layout leaves open whether they are message or page, ``whole`` for those of a text that has nothing else."""
    lines = text.lstrip("﻿").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    at = 0
    while at < len(lines) and not lines[at].strip():
        at += 1
    lines = lines[at:]
    if not lines:
        return
    first = lines[0].lstrip()
    stop = next((i for i, s in enumerate(lines) if _DIFF.match(s)), None)
    whole = stop is None  # no diff at all
    body = lines[: stop if stop is not None else len(lines)]

    def header(rows: list[str]) -> Iterator[tuple[str, str]]:
        for s in rows:
            name, _, value = s.partition(":")
            if value and name.strip().lower() in ("author", "from", "user", "committer", "commit", "date", "to", "cc", "reviewer"):
                yield "header", value.strip()
            elif name.strip().lower() == "subject":
                yield "message", re.sub(r"^(?:\[[^\]]*\bPATCH\b[^\]]*\]\s*)+", "", value.strip())

    if re.match(r"commit [0-9a-fA-F]{6,}", first) or re.match(r"From [0-9a-fA-F]{6,}", first):
        mail = first.startswith("From ")
        n = next((i for i, s in enumerate(body) if not s.strip()), len(body))
        yield from header(body[:n])
        rest = body[n:]
        if mail:
            # a section of the message may be underlined with three dashes, too
            rules = [i for i, s in enumerate(rest) if s.rstrip() == "---"]
            m = next((i for i in rules if _STAT.fullmatch("".join(rest[i + 1 : i + 2]))), rules[0] if rules else len(rest))
            for s in rest[:m]:
                yield "message", s
            page = [s for s in rest[m + 1 :] if not _STAT.fullmatch(s)]
            sign = next((i for i, s in enumerate(page) if s.rstrip("\n") == "-- "), len(page))
            page = page[:sign]
        else:
            m = next((i for i, s in enumerate(rest) if s.strip() and not s.startswith("    ") and not s.startswith("\t")), len(rest))
            for s in rest[:m]:
                yield "message", s
            page = rest[m:]
        for s in page:
            if whole or not _STAT.fullmatch(s):
                yield "page" if whole else "message", s
    elif first.startswith("changeset:"):
        n = next((i for i, s in enumerate(body) if s.startswith("description:")), len(body) - 1)
        yield from header(body[:n])
        rest = body[n + 1 :]
        m = next((i for i in range(1, len(rest)) if not rest[i].strip() and not rest[i - 1].strip()), len(rest))
        for s in rest[:m]:
            yield "message", s
        for s in rest[m:]:
            yield "page" if whole else "message", s
    elif one := _ONE.match(first):
        tail = _ONE_TAIL.fullmatch(one[1])
        yield "message", tail[1] if tail else one[1]
        if tail:
            yield "header", tail[2]
        for s in body[1:]:
            yield "message", s
            if whole:
                yield "tail", s
    elif whole:
        for s in body:
            yield "whole", s
    else:
        for s in body:
            yield "message", s


def _split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out: list = []
        for i, s, t in zip(pdf["doc_id"], pdf["source"], pdf["text"]):
            seen = set()
            for role, line in _units(t):
                line = _mask(line)
                if line and not (role == "message" and line[0] == ">") and (role, line) not in seen:
                    seen.add((role, line))
                    out.append((i, s, role, line))
        yield pd.DataFrame(out, columns=["doc_id", "source", "role", "line"])


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["reason"] = [_verdict(*x) for x in zip(pdf["role"], pdf["line"], pdf["records"], pdf["sources"])]
        yield pdf[pdf["reason"].notna()][["k", "n", "reason"]]


def residue(docs: DataFrame) -> DataFrame:
    """(doc_id, reason): one row for each record that holds residue, with the first of its reasons in alphabetical order.

    Null, empty and blank texts are no cases, a null source counts as a source,
    a null doc_id is left out, repeated rows give one row, an empty table an
    empty result; further columns are ignored. Whole texts are read.
    """
    src = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), "text")
    units = src.mapInPandas(_split, "doc_id bigint, source string, role string, line string")
    units = materialize(units.withColumn("k", F.struct("role", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(13), "line").alias("h2"))))
    lines = units.groupBy("k").agg(F.count("*").alias("n"), F.min("source").alias("s1"), F.max("source").alias("s2"), F.first("line").alias("line"))
    # what stands in place of diffs, by line alone, for the roles that leave it open
    page = lines.where("k.role = 'page'").select(F.col("k.h1").alias("p1"), F.col("k.h2").alias("p2"), F.col("n").alias("records"), F.when(F.col("s1") < F.col("s2"), 2).otherwise(1).alias("sources"))
    lines = lines.join(page, (F.col("k.h1") == F.col("p1")) & (F.col("k.h2") == F.col("p2")), "left")
    found = lines.select("k", F.col("k.role").alias("role"), "line", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("sources", F.lit(0)).alias("sources"), "n").mapInPandas(_judge, f"k {units.schema['k'].dataType.simpleString()}, n bigint, reason string")
    hits = heavy_lookup_join(units.select("doc_id", "k"), materialize(found), "k", "n", units.count())
    return hits.groupBy("doc_id").agg(F.min("reason").alias("reason"))


def without_residue(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are no cases, all columns kept; null and blank texts stay."""
    found = residue(docs).select(F.col("doc_id").alias("_case"))
    return docs.join(found, docs["doc_id"] == F.col("_case"), "left_anti")
