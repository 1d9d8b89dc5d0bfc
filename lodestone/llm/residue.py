"""Texts with the residue of a template, filler, an error page or a notice about scripts.

1. Each text is cut into blocks at blank lines; fenced code, inline code and quoted
   spans are blanked out first, so a text that reports or programs with such wording
   keeps its own content.
2. Records of one template are aligned: a line becomes its skeleton, in which
   unfilled variables, identifiers of the code base and numbers are slots. A slot that
   still holds a variable in delimiters of a template language is residue. Delimiters
   that plain text uses as well (``<x>``, ``{x}``, ``$x$``, ``[x here]``) count if the
   corpus knows x as a variable name from the others.
3. Pages are aligned by their blocks' skeletons. A sentence is described by concepts of
   its words (failing, page, access, script, text, place, ...; a lexicon of stems, no
   sentences) and by how much of it they cover. A block that says nothing of its own
   and fails over a page, asks for scripts or keeps a text's place is residue; one that
   does so weakly is if its template repeats. Blocks that share a sentence are records
   of one page template whose other part is a slot: where the sentence stands beside
   known wording in most of its blocks, what else fills that slot is residue as well,
   whatever its words.
4. Slots are induced from records of one template. Labelled lines (``Owner: x``) are
   aligned by the skeleton of the label, sentences with a gap (``____``) by their own;
   where the value varies over records, the position is a slot. A slot is residue if it
   is left blank, holds a variable's name, bare or in delimiters that plain text uses,
   or holds a default: a value that many records share while the others are mostly
   their own. A value that varies little (a status) has no default.

The scan emits a few signals of few documents; only these are shuffled, with counts
per template and variable pre-aggregated, so a text with a third of all rows or a hot
template costs nothing but its scan. Gaps in sentences are rare; only where there
are any, a second scan gives the sentences that they are aligned with, aggregated per
batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from http import HTTPStatus

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import cut

#: Documents that a page template worded only weakly must have.
REPEATS = 3
#: Share of a sentence's words that concepts must cover for it to count by itself.
STRONG = 0.5
#: Records that must hold a value for it to be their slot's default.
DEFAULTS = 10
SIGNALS = "kind string, template string, variable string"

# Delimiters of template languages around a variable's name.
_NAME = r"[A-Za-z][A-Za-z0-9]*(?:[_. ][A-Za-z0-9]+)*"
_SURE = re.compile(
    rf"\{{\{{ ?({_NAME}) ?(?:\| ?[\w: ]+)?\}}\}}|\$\{{({_NAME})\}}|#\{{({_NAME})\}}|%\(({_NAME})\)[sd]|<%=? ?({_NAME}) ?%>|@@({_NAME})@@|%%({_NAME})%%|\*\|({_NAME})\|\*|\b__([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*)__|\[INSERT ({_NAME})\]"
)
_MAYBE = re.compile(rf"\[\[({_NAME})\]\]|<<({_NAME})>>|<your ({_NAME})>|\[({_NAME}) here\]|(?<![\w<])<({_NAME})>|(?<![\w{{$#])\{{({_NAME})\}}|(?<![\w$])\$({_NAME})\$(?![\w$])")

#: What every delimiter begins with.
_MARKS = re.compile(r"[{<\[%@$#*]|__")

# Spans that quote, and code.
_QUOTED = re.compile(r"```.*?(?:```|\Z)|`[^`\n]*`|\"[^\"\n]*\"|“[^”\n]*”|„[^“”\n]*[“”]|«[^»\n]*»|「[^」\n]*」", re.S)
_INVISIBLE = re.compile("[​‌⁠﻿­]")
_IDENTIFIER = re.compile(r"(?<![\w/])[A-Za-z]+_\w+(?:\.\w+)*")
_NUMBER = re.compile(r"\b[0-9a-f]*\d[0-9a-f]*\b")
_ADDRESS = re.compile(r"(?<!\w)/[a-z]+(?:/[\w-]+)*")
_SENTENCE = re.compile(r"(?<=[.!?。！？])\s+|\n")
# A labelled line, a value left blank, a gap within a sentence.
_FIELD = re.compile(r"^[ \t]*(?:[-*#>|]+ +)*([^\s:][^\n:]*):(?:[ \t]+([^\n]*))?$", re.M)
_BLANK = re.compile(r"(?:_{2,}|\.{2,}|…|-{2,}|\?+|\[\s*\]|\(\s*\)|<\s*>|\b(?:TBD|TBA)\b\.?|\s)*")
_GAP = re.compile(r"(?<!\w)_{3,}(?!\w)")

# Stems of words by concept, in several languages; the second table for scripts without blanks. Function words, which say nothing.
_STEMS = {
    "fail": "error fail fault wrong broke dead down crash unavailable unreachable denied deny forbid unauthori expire timeout oops missing gone lost invalid maintenance unknown sorry trouble problem fehler serverfehler verweiger abgelaufen gesperrt fehlgeschlagen ungültig erreur refus interdit expir introuvable indisponible échou échec denegad prohibid caducad fallo fallid inválid σφάλμα λάθος έληξε αποτυχ απαγορε errore negato scadut vietat erro negado expirou fout geweigerd verlopen ошибк запрещ истек недоступ out",
    "neg": "not no cannot never nothing nobody without nicht kein nie ne pas sans aucun sin ningun δεν χωρίς non senza não sem niet geen zonder не нет без",
    "find": "found find exist available reach locat load open display show view access moved deleted removed connect answer respon complet process live gefunden gibt erreichbar verfügbar geladen trouv charg affich accessible encontr dispon carg mostrar abrir βρέθηκ υπάρχ διαθέσιμ φόρτωσ επιτρέπ trovat disponib encontrad gevonden beschikbaar найден существ",
    "page": "page document article site website link url address content file item record resource entry topic session request server service database gateway host proxy connection status http code reference app application seite adresse inhalt sitzung anfrage dienst datenbank dokument lien contenu requête serveur enlace contenido sesión solicitud servidor página sitio recurso σελίδ σύνδεσ διακομιστ περιεχόμεν pagina risorsa sessione sessão страниц сервер сесси документ",
    "access": "access permission permit right allow sign log zugriff berechtig anmeld angemeldet accès droit autoris connect acceso permis πρόσβασ δικαίωμ accesso acesso toegang доступ",
    "again": "again later temporarily meanwhile unexpected internal something anything occur happen side detail team told survenue produ aufgetreten passier unerwartet intern retry reload refresh minute moment soon back erneut später réessay tard inténtel intent tarde ξανά αργότερα riprova tentar opnieuw позже",
    "script": "javascript js script scripting noscript skript",
    "enable": "enable disable turn switch activ block require need support browser setting work start see view allow off on extension aktivier deaktivier erlaub benötig funktionier darstell désactiv fonctionn navigateur besoin desactiv navegador necesit requier funcion ενεργοποι απενεργοπ φυλλομετρ πρόγραμμα attiv disattiv ative ingeschakeld включ браузер",
    "text": "text content paragraph description title introduction intro word section body summary sentence heading line caption placeholder texte titre paragraphe texto título párrafo contenido platzhalter platzhaltertext absatz beschreibung inhalt κείμενο τίτλος περιγραφ testo tekst текст",
    "dummy": "sample dummy placeholder default example ejemplo platzhalter exemple παράδειγμα esempio exemplo voorbeeld",
    "place": "here goes go comes come follow added replace insert placeholder enter type put write writing edit delete own later hier steht ersetzen einfügen später ici remplacer décri insér aquí ejemplo sustituya reemplac escrib εδώ μπαίνει συμπληρ qui inserisci aqui insira vervang здесь вставьте замените",
}
_SUBSTRINGS = {
    "fail": "错误 失败 拒绝 禁止 过期 不存在 找不到 无法 异常 エラー 失敗 拒否 見つかりません 切れ 错誤 錯誤",
    "page": "页面 网页 服务器 会话 链接 请求 访问 内容 ページ サーバー アクセス セッション 頁面 伺服器",
    "again": "稍后 再试 重试 后重试 しばらく 再度 もう一度",
    "script": "javascript js 脚本 スクリプト",
    "enable": "启用 禁用 开启 打开 浏览器 啟用 有効 無効 ブラウザ 表示",
    "text": "文本 文字 内容 描述 标题 段落 本文 説明 テキスト タイトル",
    "place": "此处 在此 这里 输入 填写 替换 ここ 入力 置き換え",
}
_FUNCTION = frozenset("the a an this that these those our your you we it he she they them its of to in on at by for from with and or but if is are was were be been being has have had may might can could will would do does did so as then please what which who when how there's it's i my me us about some any all more than also just only into up der die das den dem des ein eine einen es sie ihr ihre ihren ist sind war wird werden hat haben zu zum zur um mit für von auf im am bitte und oder nicht lässt sich le la les l un une du de d est sont été à au aux pour par sur dans et ou veuillez votre vous cette ce cet il elle se que qui el los las una unos son ha han sido por para con en y o su sus este esta al del lo ο η το οι τα του της των στη στην στο σε και να για με μια ένα αυτή αυτό gli è di da per che os é em com het een van op te в на и по к".split())
# Stems that stand for whole words only, short ones always do.
_WHOLE = frozenset("sign live come goes line type host code text word body hier pas fout".split())
#: The reasons of the statuses that HTTP knows for failures.
_REASON = re.compile(r"\b(?:%s)\b" % "|".join(sorted({re.escape(s.phrase.lower()) for s in HTTPStatus if s >= 400} | {"gateway time-out", "request time-out"}, key=len, reverse=True)))
_STATUS = re.compile(r"\b(?:%s)\b" % "|".join(str(int(s)) for s in HTTPStatus if s >= 400))
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
_LETTERS = re.compile(r"[^\W\d_]+")
_ELIDED = re.compile(r"^(?:l|d|n|j|s|m|qu)'")
# Words of the usual filler text, words typed to fill a space.
_LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua donec eget urna nisi felis tellus quam porta pharetra cursus arcu massa morbi nulla ultrices vitae".split()
)
_TYPED = frozenset("asdf qwertz qwerty xxx bla blah foo bar test text word content dummy".split())


def _fold(s: str) -> str:
    return s.casefold().replace("’", "'").replace("ς", "σ")


_BY_STEM = [(concept, _fold(stem)) for concept, stems in _STEMS.items() for stem in stems.split()]
_BY_PART = [(concept, part) for concept, parts in _SUBSTRINGS.items() for part in parts.split()]


@lru_cache(200_000)
def concepts(word: str) -> frozenset[str] | None:
    """The concepts of a folded word; None for a function word."""
    found = {"neg"} if word.endswith("n't") or word.startswith("n'") else set()
    word = re.sub(r"(?:n't|'\w+)$", "", _ELIDED.sub("", word))
    for concept, stem in _BY_STEM:
        if word in (stem, stem + "s", stem + "ed") or (len(stem) >= 4 and stem not in _WHOLE and word.startswith(stem)):
            found.add(concept)
    return frozenset(found) if found or word not in _FUNCTION else None


def judge(sentence: str, named: bool = False, failed: bool = False) -> tuple[str | None, float, bool]:
    """(kind, cover, weak) of a sentence's folded skeleton: what its concepts make it, the share of it that they cover, whether it may be one if it repeats.

    named: whether it names something of the code base, which only filler does.
    failed: whether it holds the number of a failure that HTTP knows.
    """
    rest, n_reasons = _REASON.subn(" ", sentence)
    have = {"fail"} if n_reasons else set()
    if _UNSPACED.search(rest):
        left = rest
        for concept, part in _BY_PART:
            if part in left or part in rest:
                have.add(concept)
                left = left.replace(part, " ")
        # About four of ten signs are function words or endings.
        cover = 1 - 0.6 * len(_UNSPACED.findall(left)) / max(len(_UNSPACED.findall(rest)), 1)
    else:
        words = [c for w in _WORD.findall(rest) if (c := concepts(w)) is not None]
        have = have.union(*words)
        cover = (n_reasons + sum(map(bool, words))) / max(n_reasons + len(words), 1)
    slot = "¤" in sentence
    if not named:
        if "script" in have and have & {"enable", "neg", "fail"}:
            return "notice", cover, True
        if failed and have and cover == 1 and have <= {"page", "fail", "find"}:
            return "error", cover, True
        if "fail" in have and (slot or (cover >= 0.75 and "place" not in have) or have & {"page", "access", "find", "again"}):
            return "error", cover, True
        if have >= {"neg", "find"} and (slot or "page" in have) or "access" in have and have & {"neg", "enable"}:
            return "error", cover, True
        if "dummy" in have and have & {"text", "page"}:
            return "filler", cover, True
    if have >= {"text", "place"}:
        return "filler", cover, True
    return None, cover if have else 0.0, "fail" in have


def _variable(groups: tuple[str | None, ...]) -> str:
    return re.sub(r"[ .]", "_", next(g for g in groups if g).lower())


def _skeleton(text: str) -> str:
    for pattern in (_ADDRESS, _IDENTIFIER, _NUMBER):
        text = pattern.sub("¤", text)
    return re.sub(r"\s+", " ", text).strip()


def _bare(sentence: str) -> str:
    """A sentence without what may surround it: marks at its end, a reference number, a heading's or list's mark."""
    sentence = re.sub(r"^(?:[#>*-]+ )+", "", sentence)
    return re.sub(r"[\s.!?。！…]*(?:\(¤\))?[\s.!?。！…]*$", "", sentence)


def _clean(text: str | None) -> str:
    """A text with plain line ends and blanks, without invisible characters, quotes and code."""
    if not text or text.isspace():
        return ""
    text = _INVISIBLE.sub("", text).replace(" ", " ").replace("\r\n", "\n").replace("\r", "\n")
    return _QUOTED.sub(lambda m: " “” " + "\n" * (m.group().count("\n") > 0), text)


def signals(text: str | None) -> list[tuple[str, str, str | None]]:
    """(kind, template, variable) of a text, distinct.

    kind: ``variable`` and ``maybe`` for an unfilled slot; ``error``, ``notice``,
    ``filler`` for a sentence that is one by its concepts, ``beside`` for the others of
    its block; ``likely`` for a block that is one weakly, ``page`` for the sentences of
    a block that has some concept only. Blocks that say something of their own have
    none of the last five but filler.
    """
    return _signals(_clean(text))


def _signals(text: str) -> list[tuple[str, str, str | None]]:
    found: dict[tuple[str, str, str | None], None] = {}
    for kind, pattern in (("variable", _SURE), ("maybe", _MAYBE)) if _MARKS.search(text) else ():
        for m in pattern.finditer(text):
            a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            line = _MAYBE.sub("¤", _SURE.sub("¤", text[a : b if b >= 0 else len(text)]))
            found[(kind, _skeleton(line), _variable(m.groups()))] = None
    for block in re.split(r"\n\s*\n", text):
        if not block.strip():
            continue
        words = _LETTERS.findall(_fold(block))
        if len(words) >= 4 and words[0] in _TYPED and set(words) <= _TYPED and len(set(words)) <= 2:
            found[("filler", " ".join(sorted(set(words))), None)] = None
        elif len(words) >= 5 and sum(map(_LOREM.__contains__, words)) >= 0.8 * len(words):
            found[("filler", "lorem ipsum", None)] = None
        for kind, template in _page(block, words):
            found[(kind, template, None)] = None
    return list(found)


def _have(folded: str) -> set[str]:
    """The concepts of a folded text."""
    return set().union(*filter(None, map(concepts, _WORD.findall(folded))))


def _says(sentence: str) -> bool:
    """Whether a sentence names something of the code base and says something of it."""
    return bool(_IDENTIFIER.search(sentence)) and len(_WORD.findall(_IDENTIFIER.sub(" ", sentence))) >= 3


def _page(block: str, words: list[str]) -> list[tuple[str, str]]:
    """(kind, template) of a block as a part of a page. words: its folded words."""
    sentences, tells = [], False
    parts = _SENTENCE.split(block)
    if _IDENTIFIER.search(block) and not _UNSPACED.search(block) and not set().union(*filter(None, map(concepts, set(words)))) >= {"text", "place"} and any(map(_says, parts)):
        return []  # it says something, and can't be filler
    for sentence in parts:
        if "“”" in sentence:
            tells = True
            continue
        named, folded = bool(_IDENTIFIER.search(sentence)), _fold(sentence)
        have = _have(folded)
        # A sentence that quotes or says something of what it names is content; a name alone is a title.
        says = named and _says(sentence)
        tells = tells or says
        if (says or tells) and not have >= {"text", "place"} and not _UNSPACED.search(folded):
            continue  # filler is all that it could be
        skeleton = _skeleton(_MAYBE.sub("¤", _SURE.sub("¤", sentence)).lower()) if named or "{" in sentence or "<" in sentence or "[" in sentence else _skeleton(sentence.lower())
        if bare := _bare(skeleton):
            sentences.append((bare, named, *judge(_fold(bare), named, bool(_STATUS.search(sentence)))))
    strong = {bare: kind for bare, _, kind, cover, _ in sentences if kind and cover >= STRONG and not (tells and kind != "filler")}
    bare_status = len(sentences) == 1 and bool(_STATUS.fullmatch(block.strip()))
    if tells or not (bare_status or any(cover for *_, cover, _ in sentences)):
        return [(kind, bare) for bare, kind in strong.items()]
    others = [bare for bare, named, *_ in sentences if bare not in strong and not named and re.search(r"[^\W\d_]", bare)]
    if strong:
        return [(kind, bare) for bare, kind in strong.items()] + [("beside", bare) for bare in others]
    weak = bare_status or any(weak for *_, weak in sentences)
    return [("page", bare) for bare in others] + ([("likely", " ".join(bare for bare, *_ in sentences))] if weak else [])


def fields(text: str | None) -> list[tuple[str, str, str | None]]:
    """(kind, template, value) of the positions of a text that may be slots, distinct.

    kind: ``field`` for a labelled line with a value, ``empty`` for one left blank,
    ``open`` for one with a single name in delimiters that plain text uses, ``gap`` for
    a sentence with a gap. template: the label's or sentence's skeleton.
    A label right before lines that are no fields is a heading and not left blank.
    """
    return _fields(_clean(text))


def _fields(text: str) -> list[tuple[str, str, str | None]]:
    found: dict[tuple[str, str, str | None], None] = {}
    for m in _FIELD.finditer(text):
        label, value = _skeleton(m.group(1).lower()), (m.group(2) or "").strip()
        if _BLANK.fullmatch(value):
            after = re.compile(r"\s*").match(text, m.end()).end()
            if value or after == len(text) or _FIELD.match(text, text.rfind("\n", 0, after) + 1):
                found[("empty", label, None)] = None
        elif maybe := _MAYBE.fullmatch(value.rstrip(".")):
            found[("open", label, _variable(maybe.groups()))] = None
        elif not _SURE.search(value):
            found[("field", label, _variable((value,)) if re.fullmatch(_NAME, value) else _digest(_fold(value)))] = None
    if "___" in text:
        for sentence in _SENTENCE.split(text):
            if _GAP.search(sentence) and re.search(r"[^\W_]", sentence):
                found[("gap", _aligned(sentence), None)] = None
    return list(found)


def _digest(value: str) -> str:
    """A value's place holder in the shuffle; no variable's name begins so."""
    return "#" + hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _aligned(sentence: str) -> str:
    return _bare(_skeleton(_GAP.sub("¤", sentence.strip().lower())))


def _records(df: DataFrame, text: str) -> DataFrame:
    """(template, n, low, high) of the sentences without a gap: how many, and the least and greatest digest of their values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[str, list] = {}
            for value in batch.column(text):
                for sentence in set(_SENTENCE.split(_clean(value.as_py()))):
                    template = "" if _GAP.search(sentence) else _aligned(sentence)
                    if "¤" in template:
                        own = _digest(sentence.strip().lower())
                        x = seen.setdefault(template, [0, own, own])
                        x[0], x[1], x[2] = x[0] + 1, min(x[1], own), max(x[2], own)
            columns = [pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), *(pa.array([x[k] for x in seen.values()], pa.string()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, names=["template", "n", "low", "high"])

    parts = df.select(text).mapInArrow(run, "template string, n long, low string, high string")
    return parts.groupBy("template").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, template, variable): the signals and fields of each text; NULL, empty and blank texts have none."""
    field = next(f for f in df.schema.fields if f.name == key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *s) for i, value in enumerate(batch.column(text)) for clean in (_clean(value.as_py()),) for s in (*_signals(clean), *_fields(clean))]
            keys = batch.column(key).take(pa.array([r[0] for r in rows], pa.int64()))
            columns = [pa.array([r[j] for r in rows], pa.string()) for j in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays([keys, *columns], names=[key, "kind", "template", "variable"])

    return df.select(key, text).mapInArrow(run, f"{key} {field.dataType.simpleString()}, {SIGNALS}")


def residue(df: DataFrame, key: str = "doc_id", text: str = "text", repeats: int = REPEATS, defaults: int = DEFAULTS) -> DataFrame:
    """(key, kind, template): the residue of each document that has any.

    A document may come out several times, for several templates. ``repeats`` is the
    number of documents over which a loosely worded block must repeat, and of records
    that fill a slot; ``defaults`` the number that share a default, and they must be a
    tenth of the records at least. NULL keys are judged like others; equal texts under
    different keys come out each.
    """
    found = cut(scan(df, key, text))
    names = found.where("kind = 'variable'").select("variable").distinct()
    support = found.where("kind = 'likely'").groupBy("template").agg(F.count("*").alias("n")).where(F.col("n") >= repeats).select("template")
    counts = found.where("kind in ('beside', 'page')").groupBy("template").agg(F.count_if(F.col("kind") == "beside").alias("n_beside"), F.count("*").alias("n"))
    shared = counts.where((F.col("n_beside") >= repeats) & (F.col("n_beside") * 2 >= F.col("n"))).select("template")
    known = found.where("kind in ('variable', 'error', 'notice', 'filler')")
    maybe = found.where("kind = 'maybe'").join(names, "variable", "left_semi")
    likely = found.where("kind = 'likely'").join(support, "template", "left_semi")
    filling = found.where("kind = 'page'").join(shared, "template", "left_semi").withColumn("kind", F.lit("slot"))
    every = known.unionByName(maybe).unionByName(likely).unionByName(filling).unionByName(_slots(found, names, repeats, defaults))
    gaps = found.where("kind = 'gap'")
    if not gaps.isEmpty():
        records = _records(df, text).where((F.col("n") >= repeats) & (F.col("low") < F.col("high")))
        every = every.unionByName(gaps.join(records, "template", "left_semi").withColumn("kind", F.lit("blank")))
    return every.select(key, F.when(F.col("kind").isin("maybe", "open"), "variable").otherwise(F.col("kind")).alias("kind"), "template")


def _slots(found: DataFrame, names: DataFrame, repeats: int, defaults: int) -> DataFrame:
    """The fields at induced slots that are blank, hold a variable's name or a default."""
    filled = found.where("kind = 'field'")
    values = filled.groupBy("template", "variable").agg(F.count("*").alias("n_value"))
    slots = values.groupBy("template").agg(F.sum("n_value").alias("n"), F.count("*").alias("n_values")).where((F.col("n") >= repeats) & (F.col("n_values") > 1))
    others = F.col("n") - F.col("n_value")
    default = (F.col("n_value") >= defaults) & (F.col("n_value") * 10 >= F.col("n")) & (F.col("n_values") > repeats) & ((F.col("n_values") - 1) * 2 >= others)
    shared = values.where(F.col("n_value") >= defaults).join(slots, "template").where(default).select("template", "variable")
    blank = found.where("kind in ('empty', 'open')").join(slots, "template", "left_semi").withColumn("kind", F.when(F.col("kind") == "empty", "blank").otherwise(F.col("kind")))
    named = filled.join(names, "variable", "left_semi").join(slots, "template", "left_semi").withColumn("kind", F.lit("variable"))
    return blank.unionByName(named).unionByName(filled.join(shared, ["template", "variable"], "left_semi").withColumn("kind", F.lit("default")))


def templates(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(kind, template, n_docs) of the result of ``residue``."""
    return found.groupBy("kind", "template").agg(F.count_distinct(key).alias("n_docs"))
