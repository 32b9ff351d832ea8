"""Documents with template residue, filler, error messages or script notices where content should stand."""

from __future__ import annotations

import html.entities
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editwake import session
from editwake.llm.wording import Wording, fit

BROADCAST_ROWS = 200_000

# --- placeholders ---------------------------------------------------------------------------------------------------

_NAME = r"[^\W\d_][^\W_]*(?:[ _-][^\W_]+){0,3}"
_WORDS = r"[^\W\d_]+(?:[ _-][^\W\d_]+){0,3}"
#: What a template never filled in, by syntax.
PLACEHOLDERS = {
    "triple braces": r"\{\{\{[^{}\n]*+\}\}\}",
    "double braces": rf"\{{\{{ ?({_NAME}) ?\}}\}}",
    "dollar braces": r"[$#]\{[^{}\n]++\}",
    "braces": rf"(?<![{{$#\w])\{{(?:\d{{1,2}}|{_NAME})\}}(?!\}})",
    "format name": r"%\([^()\n]++\)[sdif](?![a-z])",
    "format letter": r"(?<![0-9a-z%])%[sd](?![0-9a-z])",
    "percent": rf"(?<![0-9%])%{_NAME}%(?![0-9a-z])",
    "double angles": rf"<<\s?{_NAME}\s?>>",
    "server tag": r"<(?:%=?|\?=|\?php)[^<>\n]+[%?]>",
    "merge tag": r"\*\|[^|\n]++\|\*",
    "hashes": rf"(?<![0-9a-z#&])#{_NAME}#(?![0-9a-z])",
    "dollars": rf"(?<![0-9a-z$])\${_NAME}\$(?![0-9a-z])",
    "at signs": rf"@@\s?{_NAME}\s?@@",
    "underscores": rf"(?<![0-9A-Za-z_])__({_NAME})__(?![0-9A-Za-z_])",
    "triple brackets": rf"\[\[\[\s?{_NAME}\s?\]\]\]",
    "note to writer": r"\[(?:TODO|TBD|FIXME|XXX)\b[^\[\]\n]*+\]|\[insert [^\[\]\n]++\]",
    "insert here": r"\([^()\n]+ here\)",
    "object": r"\[object Object\]|\b0000-00-00\b|\bNaN\b|(?<!\S)undefined(?![\w ]*(?:behaviou?r|index|variable|term))",
    "blank": r"(?<![\w.])\.{5,}|(?<!\w)_{4,}(?!\w)|(?<![\w?])\?{3}(?!\?)|\bTBD\b|\bTODO\b|\bXXX\b",
    "entity": r"&([^\W\d_][\w -]{0,30});",
    "tag": rf"<({_WORDS})>",
    "brackets": rf"(?<![\[\]])\[({_WORDS})\](?![\](\[])",
}
_PLACEHOLDER = re.compile("|".join(f"(?P<p{i}>{p})" for i, p in enumerate(PLACEHOLDERS.values())))
_PLACEHOLDER_NAMES = list(PLACEHOLDERS)
_FILLED = re.compile(r"(?<!\{)\{\{[^{}|]+\|[^{}]*\}\}|\[\[[^\[\]]+\]\](?!\])")
#: Markup that looks like a placeholder but is in ordinary use.
MAGIC = {"notoc", "toc", "forcetoc", "noeditsection", "newsectionlink", "index", "noindex", "nogallery", "hiddencat", "disambig", "init", "main"}
BARE_TEMPLATES = {"reflist", "stub", "clear", "citation needed", "toc", "references", "portal", "authority control", "commons", "cn", "good article", "-"}
TAGS = set(
    "a abbr address article aside b bdi bdo blockquote body br button caption center cite code col dd del details dfn div dl dt em "
    "figure font footer form gallery h1 h2 h3 h4 h5 h6 head header hr html i img includeonly input ins kbd label li link main map math "
    "mark meta nav noinclude noscript nowiki ol onlyinclude option p poem pre q ref references rp rt ruby s samp score script section select "
    "small source span strike strong style sub summary sup syntaxhighlight table tbody td textarea tfoot th thead time title tr tt u ul var "
    "video wbr".split()
)
BRACKETED = {
    "sic", "edit", "citation needed", "clarification needed", "when", "who", "which", "where", "square brackets", "note", "update", "dead link",
    "page needed", "by whom", "according to whom", "verification needed", "emphasis added", "laughter", "original research", "a", "b", "c",
}
#: Words of a sentence that speaks about such marks.
_ABOUT = re.compile(
    r"\b(?:stands? for|variables?|parameters?|placeholders?|is explained|syntax|braces|square brackets|escaped?|"
    r"printf|typed literally|notation|means? (?:that|the)|written as|is (?:set|replaced|filled) (?:from|when|by))\b",
    re.I,
)

# --- filler ---------------------------------------------------------------------------------------------------------

#: Stems of the usual pseudo-Latin.
LOREM = (
    "lorem ipsum dolor sit amet consect adipis elit sed eiusmod tempor incidi labor magn aliq enim minim veni quis nostr exercita "
    "ullam nisi commod conseq duis aute irur reprehen volupt veli esse cill fugi null pariat except sint occaec cupid proid culp qui offici "
    "deser mollit anim est ornare tellus dona vestib amen ut et ad non eu ex in ea".split()
)
_LOREM = re.compile(r"(?:" + "|".join(LOREM) + r")(?:[a-z]{0,4})")
_SHORT_LOREM = {"ut", "et", "ad", "non", "eu", "ex", "in", "ea", "qui", "est", "sed", "sit", "esse", "quis", "nisi"}
#: Examples of what stands where a text is still to be written, whole sentences in lower case.
FILLER = """
more description of the thing | replace this paragraph with your own words | this is dummy copy and says nothing |
words will be added when we have them | write something nice here later | your content here | content will be added soon |
description goes here | title goes here | text goes here | your text here | sample text | dummy text | placeholder text | content goes here |
insert text here | add text here | headline | paragraph one | subtitle | caption | replace this paragraph with your own |
the article goes here later | to be replaced before publication | this is dummy text | content to follow | lead paragraph | click to edit text |
absatz eins | überschrift | hier steht später der artikel | blindtext | dies ist ein blindtext | mustertext | platzhaltertext |
bitte vor veröffentlichung ersetzen | ersetzen sie diesen absatz durch ihren eigenen | hier kommt der text | ihr text hier |
votre texte ici | ceci est un faux texte | à remplacer avant publication | légende | sous-titre | texte à venir | paragraphe un | titre |
remplacez ce paragraphe par le vôtre | texto de ejemplo | sustituya este párrafo por el suyo | su texto aquí | aquí irá el artículo |
aquí va el texto | título | párrafo uno | texto de exemplo | seu texto aqui | substitua este parágrafo pelo seu | aqui ficará o conteúdo |
parágrafo um | qui andrà il contenuto | testo di esempio | il tuo testo qui | sostituisci questo paragrafo con il tuo | paragrafo uno |
hier komt de tekst | voorbeeldtekst | uw tekst hier | vervang deze alinea door uw eigen tekst | alinea één | замените этот абзац своим |
здесь будет содержание статьи | пример текста | ваш текст здесь | текст-заполнитель | заголовок | абзац один | ここに本文が入ります |
後で文章を追加してください | サンプルテキスト | ダミーテキスト | 小見出し | 見出し | 段落 | ここに文章を入力してください | 此处填写正文 | 示例文本 |
请在此输入内容 | 占位文本 | 标题 | 段落一 | 正文待补充 | 正文待补 | 在这里输入内容 | 此处为占位文字 | 仮のテキストです | 本文は準備中です |
dies ist ein platzhalter und wird noch ersetzt | contenu à venir, contenu à venir | contenu à venir | o conteúdo virá aqui | texto de relleno |
sample text goes here | article body to follow | testo di prova | texto de relleno, texto de relleno | рыба-текст | testo segnaposto |
texte de remplissage | texto de preenchimento | vultekst | dit is een voorbeeldtekst | el contenido irá aquí | il contenuto andrà qui
"""
_REPEATED = re.compile(r"(?P<w>[^\W\d_]{3,})(?:[\s,]+(?P=w)){2,}")
_CROSSES = re.compile(r"x{2,}(?:[\s,]+x{2,}){2,}")
_MASHED = re.compile(r"[bcdfghjklmnpqrstvwxz]{4,}")
_TEST = re.compile(
    r"(?:(?:test|teste|prueba|prova|тест|проверка)[\s,]+){2,}.*|(?:test|prueba|prova|тест|проверка|testeintrag|essai)\b.{0,12}"
    r"(?:please ignore|bitte nicht beachten|bitte ignorieren|не обращайте внимания|por favor ignorar|merci d'ignorer|da ignorare|graag negeren)"
    r"|(?:测试|テスト|試験){2,}.*"
)
_TEST_START = re.compile(r"test|prueba|prova|тест|проверка|essai|测试|テスト|試験")
#: Digits, quotations and marks: such a passage is judged by its form, not by its wording.
_MARKED = re.compile(r"[\d\"“”«»„「」『』@{}|<>=]|\[|\]|''")
_HOME_ROW = re.compile(r"[asdfghjklqwer]+")

# --- error messages and script notices ------------------------------------------------------------------------------

#: Examples of error messages as served, whole sentences in lower case without a code before them.
ERRORS = """
not found | page not found | file not found | something went wrong | an internal error has occurred | internal server error | access denied |
access to this page is forbidden | forbidden | service unavailable | service temporarily unavailable | bad gateway | gateway timeout |
bad request | request timeout | unauthorized | too many requests | too many requests from your side | our servers could not answer in time |
this revision could not be loaded | the backend fetch was aborted | backend fetch failed | quota exceeded | quota exceeded, come back later |
the database is locked for maintenance | your session has expired | the page you asked for does not exist | we're sorry |
the link you followed is broken or the page has moved | an unexpected error occurred | connection timed out | checking your browser |
site is under maintenance | permission denied | the requested url was not found on this server | we could not find that page |
seite nicht gefunden | zugriff verweigert | zu viele anfragen | die anfrage hat zu lange gedauert | interner serverfehler |
der dienst ist vorübergehend nicht verfügbar | dienst nicht verfügbar | es ist ein fehler aufgetreten | etwas ist schiefgelaufen |
page introuvable | accès refusé | délai d'attente dépassé | le serveur n'a pas pu traiter votre demande | service indisponible |
service momentanément indisponible | trop de requêtes | une erreur est survenue | erreur interne du serveur |
página no encontrada | acceso denegado | servicio no disponible | se ha producido un error interno | demasiadas solicitudes |
tiempo de espera agotado | ha ocurrido un error | error interno del servidor | página não encontrada | acesso negado | serviço indisponível |
erro interno do servidor | ocorreu um erro | muitas solicitações | tempo esgotado | serviço temporariamente indisponível |
pagina non trovata | accesso negato | servizio non disponibile | errore interno del server | troppe richieste | si è verificato un errore |
tempo scaduto | richiesta scaduta | pagina niet gevonden | toegang geweigerd | de server reageert niet | te veel verzoeken | dienst niet beschikbaar |
er is een fout opgetreden | interne serverfout | страница не найдена | доступ запрещён | доступ запрещен | слишком много запросов |
сервер временно недоступен | внутренняя ошибка сервера | произошла ошибка | время ожидания истекло | сервис недоступен |
ページが見つかりません | アクセスが拒否されました | サーバーが混み合っています | 内部エラーが発生しました | エラーが発生しました | リクエストが多すぎます |
サービスは一時的に利用できません | タイムアウトしました | 页面不存在或已被移动 | 服务器繁忙 | 访问被拒绝 | 服务器内部错误 | 请求过多 | 请求超时 | 服务暂时不可用 |
出现错误 | 页面未找到 | 找不到页面 | 拒绝访问 | превышено время ожидания | время сеанса истекло | ошибка сервера
"""
_ERROR_SHAPES = re.compile(
    r"gateway timeout after \d+ s|java\.lang\.\w+(?:exception|error).*|(?:[a-z_]+\.)+[a-z_]*(?:exception|error)\b.*|sqlstate\[\w+\].*|curl: \(\d+\) .*|"
    r"traceback \(most recent call last\):?.*|file \".*\", line \d+, in .*|at [\w.$]+\([\w.]+:\d+\)|(?:key|value|type|attribute|index|name|runtime|zero"
    r"division)error: .*|upstream connect error.*|(?:fatal error|warning|notice|parse error): (?:undefined|uncaught|call to|syntax error).*|"
    r"segmentation fault.*|connection (?:refused|reset by peer|timed out).*|failed to (?:load|fetch) .{0,40}|"
    r"(?:uncaught )?(?:type|reference|syntax|range)error: .*|ora-\d{5}.*|panic: .*"
)
_RAW_ERROR = re.compile(
    r"^[\s>]*(?:\[\d+/\d+\]\s*)?\{\s*\"(?:status|code)\"\s*:\s*\"?[45]\d\d\b|<error\b[^<>]*\bcode=|\{\s*\"error\"\s*:|<title>\s*[45]\d\d\b|<h1>\s*[45]\d\d\b|Traceback \(most recent call last\)|"
    r"\"(?:errors?|error_code)\"\s*:\s*[\[{\"]",
    re.I,
)
_CODE = re.compile(
    r"(?:(?:抱歉|sorry|désolé|извините|申し訳ありません)[\s,，、]*)?(?:(?:http|erreur|fehler|fout|errore|error|erro|ошибка|エラー|错误|notice|request failed|status)\s*)?"
    r"(?:[1-5]\d\d)?\s*[:：\-–—]?\s*"
)
_SCRIPT = re.compile(r"javascript|\bjs\b|\bscripts?\b|\bscripting\b|\bskripte?n?\b|скрипт|スクリプト|脚本", re.I)
_NEED = re.compile(
    r"\b(?:requires?|needs?|enabled?|turn(?:ed)? (?:\w+ )?(?:on|off)|allow(?:ed|s)?|blocks?|blocked|cannot (?:start|be shown)|(?:does|do|will) not work|"
    r"will only load|switched off|disabled|activate|must be on|relies on)\b|"
    r"benötigt|erfordert|funktionier\w* nicht|aktivier\w*|blockiert|deaktiviert|nicht angezeigt|nécessite|requiert|ne fonctionne pas|activez|"
    r"désactivé|bloqué|requiere|necesita|no funciona|habilit|activ[ea]|bloquead|desactivad|precisa de|requer|não funciona|ative|desativad|"
    r"richiede|non funziona|abilit|attiv|bloccat|disattivat|heeft .*nodig|vereist|werkt niet|schakel|geblokkeerd|uitgeschakeld|"
    r"требует|не работает|включите|отключ|заблокир|необходим|нуж[нед]|必要|有効|無効|動作しません|ブロック|表示できません|需要|启用|开启|禁用|无法|阻止",
    re.I,
)
_ABOUT_NOTICE = re.compile(
    r"\b(?:1[0-9]|20)\d\d\b|\b(?:notice|message|banner|asked|dropped|removed|quoted|readers|visitors|wrote|says|said|the phrase|the words|"
    r"hinweis|meldung|bandeau|message|avis|aviso|mensaje|mensagem|avviso|messaggio|melding|bericht|titled?|album|named)\b|"
    r"уведомлени|сообщени|сообщение|баннер|お知らせ|表示は|通知|提示曾|横幅|[\"“”«»„「」『』].*[\"“”«»„「」『』]",
    re.I,
)
#: What goes with an error page but proves nothing alone.
WEAK = """
désolé | lo sentimos | tut uns leid | ci dispiace | sentimos muito | het spijt ons | приносим извинения | 申し訳ありません | 抱歉 | please reload |
try again later | back | home | help | please try again | return to the main page | zurück zur startseite | retour à l'accueil | volver al inicio |
voltar ao início | извините | sign in and retry | menu search log in | privacy about | skip to content | torna alla pagina iniziale | terug naar de voorpagina | вернуться на главную | 返回首页 | 请稍后再试
"""


#: Ordinary sentences, for the model of wording where a table has few.
ORDINARY = """
agreed, the lead is too long | the village lies on a river | see the talk page | please keep the table as it is | no objection from me | the bridge was built in that year |
what happened to the second source? | a river in the north | the team won the title | reverted, no source given | nothing to see here | fixed a typo | what a game it was |
der fluss entspringt in den bergen | kein einwand von mir | die brücke wurde neu gebaut | siehe archiv | la rivière prend sa source au nord | pas d'objection | voir la discussion |
el río nace en el norte | sin objeciones | il fiume nasce nelle montagne | nessuna obiezione | o rio nasce no norte | sem objeções | de rivier ontspringt in het noorden | geen bezwaar |
река берёт начало на севере | возражений нет | см. архив | 川は北部に源を発する | 異議なし | 橋は架け直された | 河流发源于北部 | 没有异议 | 大桥已重建 | forbidden city | back in those days we were all free | the error was found by a reader
"""
#: Score above which a passage is a leftover whatever stands elsewhere, and above which it is one if other pages have it too.
SURE, SUSPECT = 1.0, -1.0
#: Bounds of the sample that the model of wording is fitted on: documents, their passages, characters of a passage.
SAMPLE_DOCS, SAMPLE_PASSAGES, SAMPLE_LENGTH = 2_000, 8_000, 2_000


def _phrases(text: str) -> frozenset[str]:
    return frozenset(" ".join(x.split()) for x in text.replace("\n", " ").split("|") if x.strip())


EXAMPLES = sorted(_phrases(FILLER) | _phrases(ERRORS))
_WEAKS = _phrases(WEAK)
_BREAK = re.compile(r"([.!?…。！？])(?:(?<=[。！？])|\s+)|[\n\r]+")
_LEAD = re.compile(r"^(?:[>*|\-•\s]+|\[\d+/\d+\]\s*|</?[a-z][^<>]{0,20}>\s*)+", re.I)
_TRAIL = re.compile(r"(?:</?[a-z][^<>]{0,20}>)$", re.I)
_ENDS = " \t\r\n\f\v 　.!。！…?"
_HINT = re.compile(r"[{}<>%#$@*&_\[\]?]")
_HINTS = (".....", "NaN", "undefined", "TBD", "TODO", "XXX", "here)", "0000")
_SCRIPT_HINTS = ("script", "js", "skript", "скрипт", "スクリプト", "脚本")
_WORD = re.compile(r"[^\W\d_]+")


@cache
def default_model() -> Wording:
    return fit(EXAMPLES, dict.fromkeys(_phrases(ORDINARY), 20))


def passages(text: str) -> list[str]:
    """Sentences and lines; noscript elements stand apart."""
    if "noscript>" in text:
        text = text.replace("<noscript>", "\n<noscript>").replace("</noscript>", "</noscript>\n")
    return [p for p in _BREAK.sub("\\1\n", text).split("\n") if p and not p.isspace()]


def bare(passage: str) -> str:
    """A passage in lower case, without list marks, counters, quote marks, tags and end marks around it."""
    if passage[0] in ">*|-•[< \t":
        passage = _LEAD.sub("", passage)
    passage = passage.rstrip(_ENDS)
    while passage.endswith(">"):
        shorter = _TRAIL.sub("", passage).rstrip(_ENDS)
        if shorter == passage:
            break
        passage = shorter
    return passage.strip().replace("’", "'").casefold()


def placeholder(passage: str) -> str | None:
    """The syntax of an unfilled placeholder in a passage that doesn't speak about such marks."""
    if not _HINT.search(passage) and not any(h in passage for h in _HINTS):
        return None
    rest = _FILLED.sub(" ", passage) if "{{" in passage or "[[" in passage else passage
    for m in _PLACEHOLDER.finditer(rest):
        kind = _PLACEHOLDER_NAMES[int(m.lastgroup[1:])] if m.lastgroup else None
        inner = next((g for g in m.groups()[m.lastindex :] if g), None) if m.lastindex else None
        word = (inner or m.group().strip("[]<>&;_{} ")).casefold()
        if kind == "underscores" and word in MAGIC or kind == "double braces" and word in BARE_TEMPLATES:
            continue
        if kind == "entity" and f"{m.group()[1:]}" in html.entities.html5 or kind == "tag" and word in TAGS or kind == "brackets" and word in BRACKETED:
            continue
        return None if _ABOUT.search(passage) else kind
    return None


@lru_cache(1 << 16)
def _word(word: str) -> tuple[int, int, int, int, int]:
    """Marks of a word in Latin letters: pseudo-Latin, pseudo-Latin of some length, mashed, from one row of keys, in a zigzag."""
    latin = bool(_LOREM.fullmatch(word))
    row = bool(_HOME_ROW.fullmatch(word))
    return latin, latin and word not in _SHORT_LOREM, bool(_MASHED.search(word)) or not re.search("[aeiouy]", word), row, row and bool(re.search("[jkq]|fd|df|lk|ds|wq|sd|rw|wr", word))


def _half_marked(words: list[str]) -> bool:
    """Whether half of the words at least have a mark: without that a passage is none of the forms told by words."""
    spare = len(words) // 2
    for w in words:
        if not any(_word(w)):
            spare -= 1
            if spare < 0:
                return False
    return True


def filler(plain: str) -> str | None:
    """Filler by its form: pseudo-Latin, crosses, mashed keys, one word over and over, test text."""
    if plain.isascii():
        words = _WORD.findall(plain)
        n = len(words)
        if n >= 2 and _half_marked(words):
            latin, long_latin, mashed, row, zigzag = (sum(x) for x in zip(*map(_word, words), strict=True))
            if latin >= 0.75 * n and long_latin >= 2:
                return "pseudo-Latin"
            if words[0][0] == "x" and _CROSSES.fullmatch(plain):
                return "crosses"
            if n >= 4 and mashed >= 0.5 * n and not re.search(r"[{}|<>=\d]", plain) or n >= 4 and row == n and zigzag >= 0.5 * n:
                return "mashed keys"
    if _REPEATED.fullmatch(plain):
        return "repeated word"
    return "test text" if _TEST_START.match(plain) and _TEST.fullmatch(plain) else None


def served(passage: str, plain: str, rest: str) -> str | None:
    """An error message or script notice by its form, standing as it was served: the whole passage, not a mention within one."""
    if ("{" in passage or "<" in passage or '"' in passage or "Traceback" in passage) and _RAW_ERROR.search(passage):
        return "raw error"
    if _ERROR_SHAPES.fullmatch(plain) or rest != plain and _ERROR_SHAPES.fullmatch(rest):
        return "error message"
    if any(h in plain for h in _SCRIPT_HINTS) and _SCRIPT.search(plain) and _NEED.search(plain) and not _ABOUT_NOTICE.search(plain):
        return "script notice"
    return None


def _uncoded(plain: str) -> str:
    """A passage without an error code before it."""
    code = _CODE.match(plain)
    return plain[code.end() :] if code else plain


def forms(text: str) -> tuple[list[str], bool, list[str]]:
    """Kinds of leftovers by form; whether the text is nothing but talk around an error page; passages left to the model."""
    kinds: list[str] = []
    found = passages(text)
    weak, open_ = 0, []
    for p in found:
        plain = bare(p)
        rest = _uncoded(plain)
        kind = placeholder(p) or filler(plain) or served(p, plain, rest)
        if kind:
            if kind not in kinds:
                kinds.append(kind)
        elif plain in _WEAKS:
            weak += 1
        elif rest and not _MARKED.search(rest):
            open_.append(rest)
    return kinds, bool(found) and weak == len(found), open_


def leftovers_of(texts: list[str | None], model: Wording | None = None) -> list[tuple[list[str], bool, list[str]]]:
    """Per text: kinds of leftovers, whether all of it is talk around an error page, suspected passages.

    A passage without digits whose wording the model puts beyond SURE is a leftover, one beyond SUSPECT is suspected, unless
    it speaks about such texts.
    NULL and empty texts have none.
    """
    by_form = [forms(t) if t else ([], False, []) for t in texts]
    scores = iter((model or default_model()).score([p for _, _, open_ in by_form for p in open_]).tolist())
    out = []
    for kinds, empty_talk, open_ in by_form:
        scored = [(p, x) for p, x in [(p, next(scores)) for p in open_] if x > SUSPECT and not _ABOUT_NOTICE.search(p) and not _ABOUT.search(p)]
        if any(x > SURE for _, x in scored):
            kinds.append("wording")
        out.append((kinds, empty_talk, sorted({p for p, x in scored if x <= SURE})))
    return out


def leftovers(text: str, model: Wording | None = None) -> tuple[list[str], bool, list[str]]:
    return leftovers_of([text], model)[0]


_SLUG = re.compile(r"[-_/]")


def terms(text: str) -> set[str]:
    return set(re.findall(r"[^\W\d_]{3,}", text.casefold()))


def _sampled(docs: DataFrame, item: str, text: str) -> dict[str, int]:
    """Frequent passages of a sample of about SAMPLE_DOCS documents in which no form of leftover is found."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))
    chosen = docs.where(F.col(text).isNotNull()).where(F.pmod(F.xxhash64(item), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).select(F.col(text)).limit(2 * SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for t in batch.column(0).to_pylist():
                kinds, _, open_ = forms(t)
                if not kinds:
                    found += {p for p in open_ if len(p) <= SAMPLE_LENGTH}
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["passage"])

    passages = chosen.mapInArrow(run, "passage string").groupBy("passage").agg(F.count(F.lit(1)).alias("n"))
    return {r.passage: r.n for r in passages.orderBy(F.desc("n"), F.xxhash64("passage")).limit(SAMPLE_PASSAGES).collect()}


def fitted(docs: DataFrame, item: str = "doc_id", text: str = "text") -> Wording:
    """The model of wording for a table: EXAMPLES against the passages of a bounded sample of its documents."""
    session.ship(docs.sparkSession)
    return fit(EXAMPLES, dict.fromkeys(_phrases(ORDINARY), 5) | _sampled(docs, item, text))


def judged(
    docs: DataFrame, item: str = "doc_id", text: str = "text", host: str = "wiki", page: str | None = None, title: str | None = None, address: str | None = None,
    titles: DataFrame | None = None, copies: int | None = None, model: Wording | None = None,
) -> DataFrame:
    """Every document: (item, kinds, low_information, leftover).

    Each passage (a sentence or a line) is held against detectors for unfilled placeholders, filler, error messages and
    script notices, and its wording against a model fitted on EXAMPLES and on a bounded sample of the table. A passage that
    speaks about such marks, or quotes them within a longer sentence, isn't one, nor is ordinary markup. A passage that the
    model only suspects is settled by evidence: it is a leftover if it has no term in common with the page's title or
    address slug (`title` and `address` of docs, or `titles`, a table (host, page, title) of any size that only suspects
    are joined with) and if enough different pages serve the same words: `copies`, by default 2 and one in 20,000
    documents, since chance makes short real passages meet as a table grows. A text that says nothing but apologies and
    ways back is low in information; it is a leftover if the host serves the same text twice. A document without a page counts as a page of its own. NULL and empty texts have no kinds and are none. Whole
    texts are read, in one pass, whatever their length. Only suspects and low-information texts are shuffled.
    """
    spark = docs.sparkSession
    session.ship(spark)
    model = model or fitted(docs, item, text)
    copies = copies or max(2, -(-docs.count() // 20_000))
    names = [x for x in (title, address) if x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(1).to_pylist()
            about = [" ".join(x or "" for x in row) for row in zip(*(c.to_pylist() for c in batch.columns[4:]), strict=True)] or [""] * len(body)
            found, low, suspects = [], [], []
            for (kinds, empty_talk, held), a in zip(leftovers_of(body, model), about, strict=True):
                named = terms(_SLUG.sub(" ", a)) if a and held else set()
                found.append(kinds)
                low.append(empty_talk)
                suspects.append([] if kinds else [p for p in held if not named & terms(p)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(low), batch.column(2), batch.column(3), pa.array(suspects, pa.list_(pa.string()))],
                names=["_ew_item", "kinds", "low_information", "_ew_hash", "_ew_place", "suspects"],
            )

    place = F.struct(F.col(host).cast("string").alias("host"), (F.col(page) if page else F.lit(None)).cast("string").alias("page"))
    chosen = docs.select(
        F.col(item).alias("_ew_item"), F.col(text).alias("_ew_text"), F.xxhash64(host, text).alias("_ew_hash"), place.alias("_ew_place"), *[F.col(n).cast("string").alias(f"_ew_n{i}") for i, n in enumerate(names)]
    )
    kind = docs.schema[item].dataType.simpleString()
    seen = session.widened(chosen).mapInArrow(run, f"_ew_item {kind}, kinds array<string>, low_information boolean, _ew_hash bigint, _ew_place struct<host:string,page:string>, suspects array<string>")
    seen = session.stage(seen, "leftovers")
    often = seen.where("low_information").groupBy("_ew_hash").agg(F.count(F.lit(1)).alias("_ew_copies")).where(F.col("_ew_copies") >= 2).select("_ew_hash")
    by_copies = seen.where("low_information").join(often, "_ew_hash", "left_semi").select("_ew_item", F.lit("low-information copies").alias("_ew_kind"))
    held = seen.select("_ew_item", "_ew_place.*", F.explode("suspects").alias("passage"))
    if titles is not None:
        words = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)
        known = titles.select(F.col("host"), F.col("page"), words(F.col("title")).alias("_ew_words")).where(F.col("page").isNotNull())
        pages = held.where("page is not null").select("host", "page").distinct()
        known = known.join(pages, ["host", "page"], "left_semi").groupBy("host", "page").agg(F.array_distinct(F.flatten(F.collect_set("_ew_words"))).alias("_ew_words"))
        held = held.join(known, ["host", "page"], "left").where(~F.coalesce(F.arrays_overlap("_ew_words", words(F.col("passage"))), F.lit(False)))
    own = F.coalesce(F.concat_ws("/", "host", "page"), F.lit("")) if page else F.lit("")
    where = F.when(F.col("page").isNull(), F.concat(F.lit("item:"), F.col("_ew_item").cast("string"))).otherwise(own)
    served_at = held.groupBy("passage", where.alias("at")).agg(F.lit(1).alias("one")).groupBy("passage").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= copies)
    by_pages = held.join(served_at.select("passage"), "passage", "left_semi").select("_ew_item", F.lit("suspected wording on several pages").alias("_ew_kind"))
    extra = by_copies.unionByName(by_pages).groupBy("_ew_item").agg(F.sort_array(F.collect_set("_ew_kind")).alias("_ew_more"))  # two kinds at most
    few = extra.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = seen.join(F.broadcast(extra) if few else extra, "_ew_item", "left")
    kinds = F.concat("kinds", F.coalesce("_ew_more", F.array().cast("array<string>")))
    return joined.select(F.col("_ew_item").alias(item), kinds.alias("kinds"), "low_information", (F.size(kinds) > 0).alias("leftover"))


def without_leftovers(docs: DataFrame, item: str = "doc_id", **how) -> DataFrame:
    """The documents that aren't leftovers, all columns as they were. Ids are unique."""
    return docs.join(judged(docs, item, **how).where("leftover").select(item), item, "left_anti").select(docs.columns)
