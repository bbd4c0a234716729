"""Template residue, filler text and error pages (problem 10).

Every line of every document is masked: fields, addresses, numbers with dates and times, and
capitalised words, which are mostly names. Lines with the same form are grouped by its hash over all
sources, counts being added up by form, source and field before they are shuffled. Rules say what a
line is: phrases of error pages and script notices, forms of address with a field in them, filler. A
phrase that can only be a message counts by itself; what may be one, a thing of the web with what
befell it, counts if its form recurs widely. A document is found that has an unfilled field, a
paragraph of filler, or says little but error message or notice.

Defined cases: null ids are left out; null, empty and blank texts hold no residue (they are empty, not filled in); repeated
rows count once; a null source is a source like any other; an empty table gives an empty result;
extra columns are ignored; texts and lines are used whole, however long.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import cut, map_arrow

#: Documents and sources a form must occur in to be widely recurring; different fields in a form of a template.
DOCUMENTS, SOURCES, FIELDS = 5, 2, 3
#: The share of a document that must be error message or notice.
SHARE = 0.5

# Ways in which fields are written (fixed values).
NOTATIONS = [
    r"\{\{\{?[^{}\n]{1,60}\}?\}\}", r"\{%[^%\n]{1,60}%\}", r"<%=?[^%\n]{1,60}%>", r"[$#]\{[^{}\n]{1,60}\}", r"\$\[[^\[\]\n]{1,60}\]", r"\[\[[^\[\]\n]{1,60}\]\]", r"<<[^<>\n]{1,60}>>", r"[«‹]\w[\w.]{1,40}[»›]", r"\*\|\w[\w:.-]{1,40}\|\*",
    r"%%?[A-Za-z_][\w .-]{0,40}%%?", r"@@[\w .-]{1,40}@@", r"#[A-Za-z_][\w .-]{1,40}#", r"\$[A-Z][A-Z0-9_]{2,40}\$?(?!\w)", r"__[A-Z][A-Z0-9_]{2,40}__", r"\|[A-Z][A-Z0-9_]{2,40}\|", r"<(?:insert|enter|your|add) [^<>\n]{1,60}>", r"[\[(](?:insert|enter|your|add|type|einfügen|insérer|insertar|inserir)\b[^\[\]()\n]{1,60}[\])]",
    r"\[[^\[\]\n]{1,40}(?: – | - |: )(?:to be completed|tbd|à compléter|por completar|a completar|auszufüllen)\]", r"\[(?!(?:PAD|SEP|CLS|MASK|UNK|BOS|EOS|INST)\])[A-Za-z][\w .'/-]{1,40}\]", r"\{[A-Za-z][\w .-]{1,40}\}", r"\{\d\}", r"<[A-Z][A-Z_ ]{2,40}>", r"&lt;[A-Za-z][\w .-]{1,40}&gt;", r"\bX{4,}\b|_{5,}",
]
FIELD = re.compile("|".join(NOTATIONS), re.I)
# A line that speaks of fields, messages or notices (fixed values).
SPEAKS = re.compile(r"(?i)\b(?:template|placeholder|variable|macro|merge[ -]?fields?|mail[ -]?merge|fields such as|type over|is filled|are filled|set \$\{|volume|vorlage|platzhalter|modèle|modelo|plantilla|copy of)\b|\bthe \[")
# Forms of address and of parties (fixed values).
ADDRESS = re.compile(r"(?i)^\W*(?:dear|hello|hi|to|attn|invoice to|bill to|ship to|prepared (?:for|by)|client|customer|name|company|address|date|amount|total|signed|signature|this (?:agreement|contract) is (?:made )?between|between|agreement between|sehr geehrte[rn]?|vertrag zwischen|rechnung an|kunde|madame|monsieur|entre|contrat entre|facture à|contrato entre|estimad[oa]s?|factura a|prezad[oa]s?|fatura para|para|von|an)\b")
# Signs of error pages, and of notices that scripts are needed, at the beginning of a sentence and anywhere in it (fixed values).
STRONG = re.compile(
    r"""(?ix)^\W*(?:
    (?:http/\d(?:\.\d)?|error|fehler|erreur|erro|ошибка|σφάλμα|エラー)[\s:]+(?:code\s*)?[45]\d\d\b(?!\s+came\b)
    |[45]\d\d\s+(?:not\ found|forbidden|unauthori[sz]ed|gone|bad\ (?:request|gateway)|internal\ server\ error|service\ unavailable|gateway\ time-?out|too\ many\ requests|proxy\ authentication\ required|request\ time-?out)
    |(?:internal\ server\ error|service\ unavailable|bad\ gateway|gateway\ time-?out|too\ many\ requests|not\ found|forbidden|unauthori[sz]ed|gone)\.\s+please\ try
    |this\ (?:site|page)\ can(?:’|')?(?:t|not)\ be\ reached|error\ name:
    |access\ denied\.|you\ do\ not\ have\ permission|an?\ (?:unexpected|unknown)\ (?:problem|error)\ (?:has\ )?occurred|oops\b|sorry,\ (?:we|the\ page)
    |file\ "[^"]+",\ line\ \d+|[\w.]+(?:error|exception):\ |at\ [\w.$]+\([\w.]+:\d+\)|traceback\ \(most\ recent\ call\ last\)|query\ failed:|warning:\ cannot|checking\ (?:that\ you\ are\ human|your\ browser)
    |your\ session\ (?:for\ \S+\ )?has\ (?:expired|timed\ out)|down\ for\ maintenance|wartungsarbeiten:|en\ maintenance|en\ mantenimiento|em\ manutenção|site\ en\ cours\ de\ maintenance|content-length:\ 0|x-trace:|request\ id:
    |acceso\ denegado\b|acesso\ negado\b|accès\ refusé\b|zugriff\ verweigert\b|service\ momentanément\ indisponible|seite\ nicht\ gefunden|page\ introuvable|página\ no\ encontrada|página\ não\ encontrada|der\ dienst\ ist\ (?:vorübergehend|derzeit)\ nicht
    |(?:you\ need\ to|please)\ (?:enable|turn\ on|allow)\ (?:javascript|scripts|scripting|cookies)\b
    |veuillez\ activer\ (?:javascript|les\ scripts)|bitte\ aktivieren\ sie\ (?:javascript|skripte)|ohne\ aktivierte\ skripte
    |(?:active|habilite)\ (?:el\ )?javascript|(?:ative|habilite)\ o\ javascript|включите\ javascript|javascript\ ?を有効|ενεργοποιήστε\ (?:την\ |τη\ )?javascript
    )"""
)
ANYWHERE = re.compile(r"""(?ix)\b(?:took\ too\ long\ to\ respond|was\ not\ found\ on\ this\ server|will\ be\ back\ shortly|javascript\ is\ (?:disabled|required|turned\ off|not\ enabled)|works\ best\ with\ scripts\ turned\ on|active\ scripting\ is\ allowed|your\ browser\ is\ not\ supported|cannot\ be\ shown\ without\ scripts)\b
    |(?:\bbrowser\.?\s+|[–—:-]\s*)(?:you\ need\ to|please)\ (?:enable|turn\ on|allow)\ (?:javascript|scripts|scripting|cookies)\b""")
# Things of the web, in the languages of the corpus, and what befalls them or is asked for (fixed values).
THINGS = {*"""problem page pages site sites website websites server servers request requests resource resources url urls link links access permission permissions session sessions connection connections gateway gateways service app apps application applications browser browsers javascript script scripts scripting cookie cookies error errors exception exceptions status login database host domain content something address
seite seiten webseite webseiten server servern anfrage anfragen zugriff sitzung verbindung dienst anwendung browsern skript skripte skripten fehler inhalt inhalte adresse berechtigung
serveur requête ressource accès connexion navigateur erreur contenu autorisation lien
página páginas sitio sitios servidor servidores solicitud recurso recursos acceso permiso permisos sesión conexión servicio aplicación navegador errores contenido enlace dirección
pedido acesso permissão sessão conexão ligação serviço aplicação erro erros conteúdo endereço sítio algo""".split()}
THINGS_ELSEWHERE = re.compile(r"страниц|сайт|сервер|запрос|ресурс|доступ|сесси|сеанс|соединени|сервис|браузер|скрипт|ошибк|σελίδα|διακομιστής|αίτημα|πρόσβαση|συνεδρία|σύνδεση|υπηρεσία|φυλλομετρητ|σφάλμα|σενάρι|javascript|ページ|サイト|サーバ|リクエスト|アクセス|セッション|接続|サービス|ブラウザ|スクリプト|エラー", re.I)
BEFALLS = re.compile(r"""(?ix)\b(?:not\ found|(?:could|can|did|does|do|was|were|is|are)(?:\ not|n['’]t|not)\ (?:be\ )?(?:found|located|load(?:ed)?|displayed|shown|processed|completed|reached|opened?|available|allowed|authori[sz]ed|permitted|supported|enabled|exist|respond(?:ing)?|work|have\ (?:access|permission))|unable\ to|fail(?:ed|s|ure)|went\ wrong|den(?:ied|y)|forbidden|refused|blocked|unauthori[sz]ed|unavailable|interrupted|expired|time[ds]?[\ -]?out|too\ long|too\ many|no\ longer|bad|invalid|broken|internal|unexpected|moved|removed|deleted|maintenance|offline|down|crashed|suspended|missing|try\ again|later|reload|refresh|go\ back|retry|requires?|required|needs?|must\ be|enable[ds]?|activate[ds]?|allow(?:ed)?|disabled|turn(?:ed)?\ o(?:n|ff)|switch(?:ed)?\ o(?:n|ff)|without\ (?:java\s?)?scripts?|supported|occurred
    |nicht\ (?:gefunden|verfügbar|erreichbar|möglich|geladen|angezeigt|gestattet|erlaubt|unterstützt|bearbeitet)|(?:konnten?|kann|können)\ (?:[^\s.]+\ ){0,6}nicht|verweigert|gesperrt|verboten|fehlgeschlagen|schiefgelaufen|abgelaufen|unterbrochen|ungültig\w*|unerwartet\w*|interner|wartung|später|erneut|aktivier\w+|benötigt|erforderlich|erlauben\ sie|zurück\ zur
    |introuvable|non\ trouvée?|n['’](?:a\ pas\ pu|est\ pas|existe)|refusée?|interdite?|indisponible|expirée?|échou\w+|interrompue?|invalide|inattendue?|interne|maintenance|plus\ tard|réessay\w+|activ(?:er|ez|és?)|requis|nécessaires?|autoris(?:er|ez)|désactivée?s?|retour\ à
    |no\ (?:se\ (?:pudo|puede|encontr\w+)|está|existe|disponible|encontrad[ao]|permitid[ao])|denegad[oa]|prohibid[oa]|rechazad[oa]|caduc\w+|expirad[oa]|falló|fallid[oa]|salió\ mal|inválid[oa]|inesperad[oa]|intern[oa]|mantenimiento|más\ tarde|de\ nuevo|inténtelo|vuelva\ a|active|activar|habilit\w+|requiere|necesita|desactivad[oa]|volver\ al
    |não\ (?:foi|pôde|pode|encontrad[ao]|está|existe|disponível|permitid[ao])|negad[oa]|proibid[oa]|recusad[oa]|expirou|falhou|correu\ mal|deu\ errado|indisponível|manutenção|mais\ tarde|novamente|ative|ativar|requer|precisa|desativad[oa]|voltar
    |не\ (?:найден\w*|удал\w+|доступ\w*|существует|отвечает|поддерживается)|запрещ\w+|отказан\w*|истек\w*|ошибк\w+|недоступ\w+|позже|включ\w+|требуется|отключ\w+|δεν\ (?:βρέθηκε|είναι|υπάρχει|ήταν)|απαγορεύεται|έληξε|απέτυχε|αργότερα|ενεργοποι\w+|απαιτ\w+)\b
    |見つかりません|できません|拒否|期限切れ|失敗|無効|メンテナンス|有効|必要|もう一度|利用できません|発生しました|\b[45]\d\d\b|\berrno\b|\bstack\ trace|\w+(?:error|exception):""")
# Function words of the languages of the corpus, to tell filler from sentences (fixed values).
FUNCTION = {*"the a an of in on at to for and or is are was were be been by with from that this it its as not no we they he she you will would can may must if when who der die das und ist sind mit von zu im am den dem ein eine nicht wird für auf le la les un une des du de et est sont dans pour par sur au aux il elle que qui ne pas el los las y es son en con por para se que una lo o os as e é são em no na do da um uma não".split()}
FOLLOWS = re.compile(r"(?i)^\W*(?:this is|here is|here goes)? ?(?:some )?(?:dummy|placeholder|filler|sample) (?:copy|text|paragraph)\b|^\W*(?:your|insert|add|type|write|enter)(?: your| a short| some)? (?:own )?(?:text|description|content|copy)(?: goes)?(?: in)?(?: this box| here)\b|^\W*(?:texto (?:fictício|de relleno|simulado|de exemplo|de ejemplo|de muestra)|texte (?:factice|d’exemple|de remplissage|provisoire)|ceci est un (?:faux )?texte|(?:saisissez|insérez|écrivez|escriba|ingrese|inserte|digite|insira|escreva|geben sie|hier steht|hier kommt)\b.{0,40}\btext[eo]?|blindtext|fülltext|platzhaltertext|beispieltext|dies ist ein (?:blind|beispiel|platzhalter|füll)text|este es un texto de (?:relleno|muestra|ejemplo)|este é um texto (?:fictício|de exemplo))\b|^\W*(?:item|section|chapter|paragraph|step|note|line)\W+\d+\W+.*\b(?:to follow|to come|tbd|to be (?:added|written|completed|supplied))\W*$|^\W*(?:text|content|description)\W+(?:to follow|goes here|to come)\W*$|^\W*(?:coming soon|under construction|your text here|type your text here)\W*$")
# A line of links, as pages have above their text.
LINKS = re.compile(r"(?:[^|]{1,40}\|){2,}[^|]{1,40}|[\w’'-]+(?: {2,}[\w’'-]+(?: [\w’'-]+)?){2,}")
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])")
# What is masked in forms, in this order; SQL's regular expressions mean the same by these (fixed values).
MASKS = [(r"https?://[^\s]+|[^\s@]+@[^\s@]+|/[A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+", "@"), (r"[0-9][0-9.,:/-]*", "0"), ("[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][A-Za-zÀ-ÖØ-öø-ÿΑ-ωά-ώА-яЁё]*", "#"), (r"[ \t\r\n\f]{2,}|[\t\r\n\f]", " ")]
_MASKS = [(re.compile(a), b) for a, b in MASKS]
# Words of pseudo-Latin, and rows of keys that fingers run along (fixed values).
LATIN = {*"lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum vestibulum pellentesque curabitur vivamus".split()}
KEYS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "qwertzuiop", "azertyuiop")
_KEYED = {k[i:j] for k in KEYS for i in range(len(k)) for j in range(i + 3, len(k) + 1)}
# Words of which each phrase that can only be a message has one, or one of THINGS or a digit (fixed values).
SAYS = {*"oops problem occurred incident loading reload sorry denied forbidden gone unauthorized unauthorised traceback warning checking wartungsarbeiten maintenance mantenimiento manutenção length trace id found permission permissions query failed back shortly denegado negado refusé verweigert indisponible indisponível javascript scripts scripting cookies script browser zugriff fehler erreur erro introuvable expired line took respond unavailable gateway try".split()}
_WITHIN = {*"respond server shortly javascript scripts scripting browser cookies".split()}
_CODE = re.compile(r"\W*(?:\w+\W+){0,2}[45]\d\d\b")
_OTHER_SCRIPT = re.compile("[\u0370-\u052f\u2e80-\ufdff]")


def filler(line: str, words: list[str]) -> bool:
    """Whether a paragraph, given with its words, is filler: words in place of sentences, or the same few words again and again."""
    n, some = len(words), {*words}
    if FOLLOWS.match(line):
        return True
    if n >= 3 and not some.isdisjoint(_KEYED) and sum(w in _KEYED for w in words) >= 0.7 * n:
        return True
    if not some.isdisjoint(LATIN):
        if n >= 5 and sum(w in LATIN for w in words) >= 0.6 * n or n < 6 and words[:2] == ["lorem", "ipsum"]:
            return True
        if n >= 6 and not some.isdisjoint(("lorem", "ipsum")):
            return sum(w in FUNCTION for w in words) <= 0.1 * n
    if n < 8:
        return n > 3 and len(some) == 1
    if len(some) > 0.35 * n:
        return False
    # one or two words that fill at least nine tenths
    return sum(sorted((words.count(w) for w in some), reverse=True)[:2]) >= 0.9 * n


def form_of(line: str, fielded: bool = True) -> str:
    """A line without what differs between copies of a message: fields, addresses, dates and numbers, capitalised words."""
    line = FIELD.sub("¤", line) if fielded else line
    for pattern, mark in _MASKS if "@" in line or "/" in line else _MASKS[1:]:
        line = pattern.sub(mark, line)
    return line.strip()


def _telling(words: set[str], line: str) -> tuple[bool, bool]:
    """(whether a line can have a phrase that is a message, whether it names a thing of the web), by its words alone."""
    if not line.isascii() and _OTHER_SCRIPT.search(line):
        return True, bool(THINGS_ELSEWHERE.search(line))
    thing = not words.isdisjoint(THINGS)
    return thing or not words.isdisjoint(SAYS) or _CODE.match(line) is not None, thing


def lines_of(text: str) -> list[str]:
    return [x for x in map(str.strip, text.split("\n")) if x]


#: What a line is, in bits: a field in a form of address (or several fields); a field elsewhere; filler; a phrase that can only be a message; one that may be.
ADDRESSED, FIELDED, FILLER, MESSAGE, PERHAPS = 1, 2, 4, 8, 16


def judged_line(line: str, fielded: bool = True) -> tuple[int, str, int, int]:
    """(bits, field, characters that are surely message, characters that may be) of a line, sentence by sentence; fielded: it can have a field."""
    bits, first, sure, maybe = 0, "", 0, 0
    words = _WORD.findall(line.lower())
    if filler(line, words):
        if not fielded:
            return FILLER, "", 0, 0
        bits = FILLER
    message, thing = _telling({*words}, line)
    if not fielded and not message:
        return 0, "", 0, 0
    sentences = _SENTENCE.split(line) if len(line) > 60 else [line]
    for x in sentences:
        if len(sentences) > 1:
            words = {*_WORD.findall(x.lower())}
            message, thing = _telling(words, x)
        found = [m[0] for m in FIELD.finditer(x)] if fielded else []
        if found:
            first = first or found[0]
            if SPEAKS.search(x) and not ADDRESS.search(x):
                continue
            bits |= ADDRESSED if ADDRESS.search(x) or len({*found}) > 1 else FIELDED
        elif message and (STRONG.match(x) or not _WITHIN.isdisjoint(words) and ANYWHERE.search(x)):
            bits |= MESSAGE
            sure += len(x)
        elif thing and BEFALLS.search(x):
            bits |= PERHAPS
            maybe += len(x)
        elif bits & (MESSAGE | PERHAPS) and len(x) < 60:  # the rest of a message
            maybe += len(x)
    return bits, first, sure, maybe


_QUICK = re.compile(r"[{}\[<>%@#$«‹*|&(]|_{5}|X{4}|__")


def line_forms(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, whole, lines): of each document, the characters of its lines other than lines of links, and of each
    line the hash of its form, what it is, the hash of its field, and how much of it is or may be message."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null and text <> ''")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def make():
        hashed = lambda x: xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)

        def f(batch: pa.RecordBatch) -> dict:
            wholes, lists = [], []
            for text in batch.column(2).to_pylist():
                lines = lines_of(text)
                wholes.append(sum(len(x) for x in lines if not LINKS.fullmatch(x)))
                out = []
                for x in lines:
                    fielded = _QUICK.search(x) is not None
                    bits, field, sure, maybe = judged_line(x, fielded)
                    out.append({"form": hashed(form_of(x, fielded)), "bits": bits, "field": hashed(field) if field else 0, "sure": sure, "maybe": maybe})
                lists.append(out)
            return {"doc_id": batch.column(0), "source": batch.column(1), "whole": wholes, "lines": lists}

        return f

    return map_arrow(rows, make, f"doc_id {kind}, source string, whole int, lines array<struct<form: bigint, bits: int, field: bigint, sure: int, maybe: int>>")


def wide_forms(each: DataFrame) -> DataFrame:
    """(form, documents, sources, fields) of the forms that recur widely; each: (doc_id, source, form, field), a row for each line.

    Copies are folded by (form, source, field) before forms are counted, so a form of very many documents is a few rows."""
    folded = each.select("form", "doc_id", F.coalesce("source", F.lit("")).alias("source"), "field").distinct().groupBy("form", "source", "field").agg(F.count("*").alias("n"))
    forms = folded.groupBy("form").agg(F.sum("n").alias("documents"), F.count_distinct("source").alias("sources"), F.count_distinct(F.when(F.col("field") != 0, F.col("field"))).alias("fields"))
    return forms.where(f"documents >= {DOCUMENTS} and sources >= {SOURCES}")


def residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, fields, filler, page): documents with unfilled fields, paragraphs of filler, or that are an error page or notice."""
    documents = cut(line_forms(docs, id_col, text_col, source_col), "lines")
    each = documents.select("doc_id", "source", "whole", F.posexplode("lines").alias("at", "x")).select("doc_id", "source", "whole", "at", "x.*")
    wide = wide_forms(each).select("form", "fields")
    bit = lambda b: F.col("bits").bitwiseAND(b) != 0
    marked = each.where("bits <> 0").distinct().join(wide, "form", "left")
    recurs = F.col("fields").isNotNull()
    unfilled = bit(ADDRESSED) | bit(FIELDED) & recurs & (F.col("fields") >= FIELDS)
    said = F.when(bit(MESSAGE), F.col("sure") + F.col("maybe")).when(bit(PERHAPS) & recurs, F.col("maybe")).otherwise(0)
    per = marked.groupBy("doc_id", "whole").agg(F.count_if(unfilled).alias("fields"), F.count_if(bit(FILLER)).alias("filler"), F.sum(said).alias("said"))
    page = (F.col("said") > 0) & (F.col("said") >= SHARE * F.col("whole"))
    found = per.withColumn("page", page).groupBy("doc_id").agg(F.max("fields").alias("fields"), F.max("filler").alias("filler"), F.max("page").alias("page"))
    return found.where("fields > 0 or filler > 0 or page")


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(form, documents, sources): the grouping stage by itself, with forms in full and fields left as they are, as SQL can express it."""
    form = F.col("line")
    for pattern, mark in MASKS:
        form = F.regexp_replace(form, pattern, mark)
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.explode(F.split(text_col, "\n")).alias("line"))
    each = lines.select("doc_id", "source", F.trim(form).alias("form"), F.lit(0).alias("field")).where("form <> ''")
    return wide_forms(each).select("form", "documents", "sources")


def without_residue(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that hold no residue, with all their columns."""
    return docs.join(residue(docs, id_col, text_col, source_col).select(F.col("doc_id").alias(id_col)), id_col, "left_anti")
