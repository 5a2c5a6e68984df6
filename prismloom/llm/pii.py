"""Personal information in free text: offset-preserving deobfuscation.

A text passes transducers that undo disguises (full-width and look-alike letters,
invisible characters, ``(at)``/``[dot]`` and their spelled forms, spelled digits) while
recording for every normalised character the source span it came from. Detectors run on
the normalised text, and their spans are mapped back, so reported positions are those
of the untouched source.

Kinds: ``email``, ``phone``, ``id_number``, ``address``, ``name``. Spans never overlap; an
earlier kind of the list email, id_number, address, phone, name claims its characters first.

Results for odd input: null and empty texts have no occurrence and stay as they are; a
text of any length is scanned whole; repeated rows give repeated occurrences of their own
doc_id. The operator works row by row without a shuffle, in Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.balance import spread
from .names import features, is_person, weights

KINDS = ("email", "phone", "id_number", "address", "name")

# --- fixed values -----------------------------------------------------------------
#: Look-alike letters of other scripts and the Latin letter each stands for.
HOMOGLYPHS = dict(zip("авеіјкмнорԛѕтухѵԝАВЕІЈКМНОРЅТХУαεικνορτυχΑΒΕΗΙΚΜΝΟΡΤΥΧΖ", "abeijkmhopqstyxvwABEIJKMHOPSTXYaeikvoptuxABEHIKMNOPTYXZ", strict=True))
INVISIBLE = "­​‌‍‎‏⁠﻿"
DASHES = "‐‑‒–—−"
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
HAN_DIGITS = {"零": "0", "〇": "0", "一": "1", "幺": "1", "二": "2", "三": "3", "四": "4", "五": "5", "六": "6", "七": "7", "八": "8", "九": "9"}
FILE_ENDINGS = ("png", "jpg", "jpeg", "gif", "webp", "bmp", "tif", "tiff", "svg", "parquet", "json", "jsonl", "csv", "tar", "gz", "zip", "txt", "mp4")
COMPOUND_SURNAMES = "欧阳 太史 端木 上官 司马 东方 独孤 南宫 万俟 闻人 夏侯 诸葛 尉迟 公羊 赫连 澹台 皇甫 宗政 濮阳 公冶 太叔 申屠 公孙 慕容 仲孙 钟离 长孙 宇文 司徒 鲜于 司空 令狐 百里 呼延 东郭 南门 西门".split()
#: The most common family names of one character.
SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗高郑梁谢宋唐许韩邓冯曹彭曾萧田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常汤康易乔赖文施洪辛柯庄温牛樊葛邢安齐伍庞颜倪季俞章鲁申詹关柴凌毕骆焦涂耿聂翟宁包裴尚纪舒柳岳祝左霍成苗管柏翁童卞褚卫尤华戚喻云费岑凤花明"
STREET_KINDS = "Street St Road Rd Avenue Ave Lane Ln Way Court Ct Close Drive Dr Boulevard Blvd Place Pl Terrace Square Sq Crescent Row Walk Hill Gardens Grove Quay Parade Mews".split()
# ----------------------------------------------------------------------------------

_CHARS = {ord(c): t for c, t in HOMOGLYPHS.items()} | {ord(c): "-" for c in DASHES} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict.fromkeys((0x3000, 0xA0, 0x2002, 0x2003, 0x2009), " ")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_WORD = "|".join([*DIGIT_WORDS, "double", "triple"])
_REWRITE = re.compile(
    r"(?P<at>(?<=[A-Za-z0-9])\s*[\[({<]\s*(?:at|@|艾特)\s*[\])}>]\s*(?=[A-Za-z0-9])"
    r"|(?<=[A-Za-z0-9]) (?:at|AT) (?=[A-Za-z0-9-]+(?: (?:dot|DOT) [A-Za-z0-9-]+)+)"
    r"|(?<=[A-Za-z0-9])\s?@\s?(?=[A-Za-z0-9-]+\s?(?:[\[({]\s*(?:dot|\.)\s*[\])}]|\sdot\s)))"
    r"|(?P<dot>(?<=[A-Za-z0-9])\s*[\[({<]\s*(?:dot|\.|点)\s*[\])}>]\s*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9]) (?:dot|DOT) (?=[A-Za-z0-9]))"
    rf"|(?P<digits>(?<![A-Za-z])(?:{_WORD})(?:[\s,-]+(?:{_WORD})){{4,}}(?![A-Za-z]))"
    r"|(?P<han>[零〇一二三四五六七八九幺]{7,})",
    re.I,
)
#: Cheap signs that a text may hold a disguise; without one the transducer is skipped.
_DISGUISED = re.compile(r"[\[({<]\s*(?:at|@|dot|\.|点|艾特)\s*[\])}>]|[零〇一二三四五六七八九幺]{7}", re.I)
_DIGIT_RUN = re.compile(rf"\b(?:{_WORD})[\s,-]+(?:{_WORD})[\s,-]+(?:{_WORD})")


def _spell(text: str) -> str:
    out, times = [], 1
    for word in re.findall(r"[a-z]+", text.lower()):
        if word in ("double", "triple"):
            times = 2 if word == "double" else 3
        else:
            out.append(DIGIT_WORDS[word] * times)
            times = 1
    return "".join(out)


class Aligned:
    """Normalised text with the source span of each of its characters."""

    __slots__ = ("text", "starts", "anchors", "widths")

    def __init__(self, source: str):
        plain = source.isascii()
        text = source if plain else source.translate(_CHARS)
        kept = None
        if not plain and _INVISIBLE.search(text):
            kept = [i for i, c in enumerate(text) if c not in INVISIBLE]
            text = "".join(text[i] for i in kept)
        # anchors: (position in the result, position before rewriting, width before, is rewritten)
        pieces, anchors, pos, done = [], [(0, 0, 1, False)], 0, 0
        disguised = _DISGUISED.search(text) or " dot " in (low := text.lower()) or _DIGIT_RUN.search(low)
        for m in _REWRITE.finditer(text) if disguised else ():
            plain = text[done : m.start()]
            pieces.append(plain)
            pos += len(plain)
            new = "@" if m["at"] else "." if m["dot"] else _spell(m[0]) if m["digits"] else "".join(HAN_DIGITS[c] for c in m[0])
            anchors.append((pos, m.start(), m.end() - m.start(), len(new)))
            pieces.append(new)
            pos += len(new)
            anchors.append((pos, m.end(), 1, False))
            done = m.end()
        pieces.append(text[done:])
        self.text = "".join(pieces) if len(anchors) > 1 else text
        self.anchors, self.starts, self.widths = anchors, [a[0] for a in anchors], kept

    def _before(self, i: int) -> tuple[int, int]:
        at, src, width, new = self.anchors[bisect_right(self.starts, i) - 1]
        if not new:
            return src + i - at, src + i - at + 1
        if new == width:
            return src + i - at, src + i - at + 1
        share = width / new
        return src + int((i - at) * share), src + max(int((i - at + 1) * share), int((i - at) * share) + 1) if i - at + 1 < new else src + width

    def source_span(self, start: int, end: int) -> tuple[int, int]:
        a, b = self._before(start)[0], self._before(end - 1)[1]
        return (self.widths[a], self.widths[b - 1] + 1) if self.widths is not None else (a, b)


_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_EMAIL = re.compile(r"(?<![A-Za-z0-9_.+%-])[A-Za-z0-9_][A-Za-z0-9._%+'-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_IDS = re.compile(
    _L
    + r"(?:(?P<han>\d{6}[ -]?(?:18|19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])[ -]?\d{3}[\dXx])"
    r"|(?P<ssn>\d{3}([ -])\d{2}\3\d{4})"
    r"|(?P<nino>[A-Za-z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-Da-d])"
    r"|(?P<pass>[A-Z]{2} ?\d{7}|[a-z]{2}\d{7})"
    r"|(?P<nie>[XYZxyz]-?\d{7}-?[A-Za-z])"
    r"|(?P<dni>\d{8}-?[A-Z])"
    r"|(?P<cued>\d{7,12}[A-Za-z]?|[A-Za-z]{1,2}\d{6,9}))" + _R
)
_ID_CUE = re.compile(r"(?:\b(?:SSN|ID|NIE|DNI|TIN|NIN|tax (?:no\.?|number|id)|social security(?: (?:no\.?|number))?|passport(?: (?:no\.?|number))?|repeat)|身份证号?码?|护照号?码?|证件号?码?|税号|证号)[\s:#：]*$", re.I)
_NOT_ID = re.compile(r"(?:seed|种子|offset|size|pid|key|rank|build|fragment|hash|sha|md5|shard)[\s:#=]*$", re.I)
_PHONES = re.compile(
    r"(?<![A-Za-z0-9_.+/-])(?<!\d )"
    r"(?:(?:\+1[ .-]?|001[ .-]|1[ .-])?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+1\d{10}"
    r"|(?:\+44 ?(?:\(0\) ?)?|0)20 \d{4} \d{4}|(?:\+44 ?(?:\(0\) ?)?|0)7\d{3} ?\d{3} ?\d{3}"
    r"|(?:\+33 ?(?:\(0\) ?)?|0)\d(?:[ .]\d{2}){4}"
    r"|\+49 ?(?:\(0\) ?)?\d{2,4}[ /-]?\d{4,6}(?:[ -]?\d{3})?"
    r"|(?:(?:\+|00)?86[ -]?)?1[3-9]\d([ -]?)\d{4}\1\d{4}"
    r"|(?:(?:\+|00)86[ -]?)?(?:\(0\d{2,3}\) ?|0\d{2,3}[ -])\d{7,8}"
    r"|\+\d{1,3}(?:[ .-]\(?\d{1,5}\)?){2,5}|\+\d{9,15})" + _R + r"(?![.-]\d)"
)
_PHONE_CUED = re.compile(r"(?:\b(?:phone|tel|mobile|fax|call|text)\b|电话|手机号?码?|拨打|致电)[\s:.=：]*(\(?\+?\d[\d ()./-]{5,18}\d)" + _R, re.I)
_NOT_PHONE = re.compile(r"(?:seed|种子|offset|size|pid|key|keys|rank|build|fragment|lat|lon|hash)[\s:#=]*$", re.I)

_UP, _LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
_CAP = rf"(?:[{_UP}]['’])?[{_UP}][{_LOW}]+(?:['’](?!s\b)[{_UP}]?[{_LOW}]+)?"
_TOWN = rf"[{_UP}][{_LOW}]+(?: [{_UP}][{_LOW}]*){{0,3}}"
_POST = r",?[ \n](?:[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2}|[A-Z]{2} \d{5}(?:-\d{4})?|\d{5})" + _R
_ROOM = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room|Floor)\.? ?|# ?)[A-Za-z0-9]+"
_STREET = rf"(?:{_ROOM}, ?)?\d{{1,5}}[a-zA-Z]?,? (?:[{_UP}][{_LOW}'’.]+ ){{1,3}}(?:{'|'.join(STREET_KINDS)})(?![a-z])"
_HEAD = re.compile(rf"{_L}(?:{_STREET}|(?:P\.? ?O\.? ?|Post Office )Box \d+)")
_CONTINENT = re.compile(
    rf"{_L}(?:(?:[{_UP}][{_LOW}]+(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer|steig)|(?:[{_UP}][{_LOW}]+[- ]){{1,2}}(?:Straße|Strasse|Allee|Platz|Weg|Gasse)) \d{{1,4}} ?[a-z]?{_R}"
    rf"|\d{{1,4}}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|allée|impasse|quai|chemin)(?: (?:de|du|des|la|le|les|l['’]|d['’])){{0,2}} ?[{_UP}][{_LOW}]+(?:['’ -][{_UP}][{_LOW}]+)*)"
    rf"(?:,? ?\n?(?:[A-Z]{{1,2}}-)?\d{{4,5}} [{_UP}][{_LOW}]+(?:-[{_UP}][{_LOW}]+)*)?"
)
_SUB = re.compile(rf"\.?,? ?\n?{_ROOM}{_R}")
_TAIL = re.compile(rf"\.?(?:, ?\n?|\n)({_TOWN})")
_POSTCODE = re.compile(_POST)
_HAN = "一-鿿"
_HAN_ADDRESS = re.compile(
    rf"(?:(?:黑龙江|内蒙古|[{_HAN}]{{2}})(?:省|自治区)[{_HAN}]{{2,4}}?[市州]|[{_HAN}]{{2}}市)(?:[{_HAN}]{{2,4}}?[区县市])?[{_HAN}]{{1,5}}?(?:路|街|巷|大道|道|弄|胡同)\d+号(?:院)?(?:\d+[栋幢座])?(?:\d+单元)?(?:\d+楼|\d+层)?(?:\d+[室号])?"
)

_INITIAL = rf"[{_UP}]\."
_FAMILY = rf"{_CAP}(?:-{_CAP})?"
_ALLCAPS = rf"[{_UP}ß]{{2,}}(?:-[{_UP}ß]{{2,}})?"
_NAME = re.compile(
    rf"(?<![A-Za-z0-9_@.-])(?:(?:{_CAP}|{_INITIAL}) ?(?:{_INITIAL} ?){{0,2}}(?<=[ .]){_FAMILY}|[{_UP}]{{2,}} (?:{_INITIAL} ){{0,2}}{_ALLCAPS}|{_INITIAL} ?{_ALLCAPS}|{_FAMILY}, (?:{_CAP}|{_INITIAL})(?: {_INITIAL})?|{_ALLCAPS}, [{_UP}]{{2,}})(?![A-Za-z0-9_@])"
)
_DIGIT, _HAN_CHAR = re.compile(r"\d"), re.compile(f"[{_HAN}]")
#: Six digits or more with at most three signs between them: every number detector needs as much.
_CLUSTER = re.compile(r"\d(?:[ ().+/-]{0,3}\d){5,}")
_STREET_WORDS = tuple(f" {k}" for k in STREET_KINDS) + ("Box ",)
_STREET_ANCHOR = re.compile(rf" (?:{'|'.join(STREET_KINDS)})(?![a-z])|Box \d+")
_CONTINENT_WORDS = ("straße", "strasse", "str. ", "gasse ", "weg ", "platz ", "allee ", "ring ", "damm ", "ufer ", "steig ", "Straße", "Strasse", "Allee", "Platz", "Weg ", "Gasse", " rue ", " avenue ", " boulevard ", " place ", " allée ", " impasse ", " quai ", " chemin ")
_NUMBERED = re.compile(r"\d号")
_NAME_PARTS, _NEXT_WORD = re.compile(r"[ ,.-]+"), re.compile(r"[ ,]+|-")
_TITLE = r"(?:(?:Mr|Mrs|Ms|Mx|Dr|Prof|Professor|Sir|Madam)\.? )?"
_BEFORE = re.compile(
    r"(?:\b(?:by|for|from|From|contact|Contact|Dear|Hello|Hi|Signed|[Rr]eviewer|[Aa]nnotator|[Aa]uthor|[Pp]hotographer|[Ss]itter|[Hh]older|[Oo]wner|reads|goes to|to|Ask|ask|[Pp]ortrait of|(?:him|her|them|it)sel(?:f|ves) as|[Oo]ld entry|[Nn]ame|[Rr]ecipient|[Aa]ttn|named|sincerely|regards|cc)[,:]?[ \n]+"
    r"|[\"“'](?:annotator|name|owner|author|reviewer)[\"”']: ?[\"“']|(?:owner|name|annotator|author|reviewer)=[\"“']?|(?:^|[\s。])[\"“]"
    r"|申请人|姓名[:：]?|收件人[:：]? ?|联系人[:：]? ?|标注员|审核员|由|写着[“\"]|署名[:：]? ?|签名[:：]? ?|和|与)" + _TITLE + r"$"
)
_AFTER = re.compile(r"['’]s (?:mask|caption|picture|label|photo|portrait|address|note)|[\"”'] ?<| (?:said|says|wrote|writes|reports|reported|replied|asked|lives|agreed|signed)\b| ?\((?:\+|\(?\d)")
_JOIN = re.compile(r"^(?: ?\([^()\n]{5,30}\))?,? (?:and|or) $|^ ?\([^()\n]{5,30}\)(?:和|与|或)$")
_STOP = {"The", "See", "Figure", "Table", "Appendix", "Style", "Flat", "Unit", "Apt", "Box", "This", "That", "Phone", "Bill", "Questions", "Reply", "Send", "Deliver", "Please", "Winter", "North", "South", "East", "West", "Ask", "Annotator", "Dear", "Signed", "Portrait", "Reviewed", "Reviewer", "Collected", "Contact", "Old", "My", "Mask", "Payment", "Whoever", "Call", "Photo", "Photographer", "Sitter", "Owner", "Holder", "Author", "Hello", "Hi", "Thanks", "Regards", "Sincerely"}
_HAN_WHO = rf"(?P<who>(?:{'|'.join(COMPOUND_SURNAMES)})[{_HAN}]{{1,2}}?|[{SURNAMES}][{_HAN}]{{1,2}}?)"
_HAN_LEFT = (
    r"(?:(?:姓名|收件人|寄件人|联系人|标注员|审核员|审核|复核|校对|标注|拍摄|撰写|翻译|负责人|摄影师|摄影|申请人|持有人|持证人|被摄者|当事人|作者|署名|签名|签字|由|听|据|写着|致|亲爱的|尊敬的)[:：“\" \n]{0,2}"
    r"|[，,、](?=[^，。]{2,4}收[。.,，])"
    r"|(?:by|for|from|From|contact|Dear|Signed:|[Rr]eviewer:|Annotator|sitter,|holder|reads|goes to|to:|Ask|or|and|Portrait of|self as|entry:)[ \n]"
    r"|[\"“'](?:annotator|name|owner|author|reviewer)[\"”']: ?[\"“']|(?:owner|name|annotator|author|reviewer)=[\"“']?)"
)
_HAN_RIGHT = r"(?=收[。.,，]|反馈|修改|选出|负责|拍摄|提交|说|的遮罩|先生|女士|老师|同意|审核|确认|和|与|、|[，,。.;；:：（(）)”\"<'\n ]|$)"
_HAN_STRONG = r"(?= ?[（(][+＋(\d]|反馈|负责|说|的遮罩|先生|女士| said| reports|'s mask|[\"”] ?<)"
_HAN_NEXT = re.compile(rf"[、和与及]{_HAN_WHO}{_HAN_RIGHT}")
#: Family names that are hardly ever the first character of a common word, for clauses without another cue.
_HAN_SURE = "王李张刘陈杨赵吴周徐孙朱胡郭何罗郑梁谢宋唐许韩邓冯曹彭曾萧董潘袁蔡蒋余杜魏苏吕卢姚沈崔谭廖韦贾邹孟秦邱尹薛闫龚邵覃戴倪俞詹骆聂翟裴霍"
_HAN_CLAUSE = rf"(?:^|[。\n;；，,“\"!！：:]|今天|昨天|明天|前天|今年|去年|后来|当时|那天|上周|下周|早上|晚上|上午|下午)(?P<who>[{_HAN_SURE}](?![家氏姓某府国朝代])[{_HAN}]{{1,2}}?)(?=在(?!于)|去了|去过|来到|来了|住在|出生|毕业|工作|告诉|认为|表示|写道|画了|拍了|把|对我|给我|和我|跟我)"
_HAN_PERSON = (re.compile(f"{_HAN_LEFT}{_HAN_WHO}{_HAN_RIGHT}"), re.compile(rf"(?:^|[。\n;；，“\"!！ .]){_HAN_WHO}{_HAN_STRONG}", re.M), re.compile(_HAN_CLAUSE, re.M))


class Spans:
    """Disjoint spans in order; whether a new one is free is found by bisection, however many there are."""

    __slots__ = ("starts", "held")

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.held: list[tuple[int, int, str]] = []

    def free(self, start: int, end: int) -> bool:
        i = bisect_right(self.starts, start)
        return (i == 0 or self.held[i - 1][1] <= start) and (i == len(self.starts) or self.starts[i] >= end)

    def take(self, start: int, end: int, kind: str) -> None:
        i = bisect_right(self.starts, start)
        self.starts.insert(i, start)
        self.held.insert(i, (start, end, kind))

    def take_free(self, start: int, end: int, kind: str) -> bool:
        ok = self.free(start, end)
        if ok:
            self.take(start, end, kind)
        return ok


def _windows(text: str, anchor: re.Pattern, before: int, after: int) -> list[tuple[int, int]]:
    """Stretches around the anchors, merged where they meet: what a costly pattern has to look at."""
    out: list[tuple[int, int]] = []
    for m in anchor.finditer(text):
        a, b = max(0, m.start() - before), min(len(text), m.end() + after)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _within(pattern: re.Pattern, text: str, windows: list[tuple[int, int]]) -> Iterator[re.Match]:
    for a, b in windows:
        yield from pattern.finditer(text, a, b)


def _cut_domain(found: str) -> str:
    """An address glued to the next sentence ends before its capitalised first word."""
    local, _, domain = found.rpartition("@")
    labels = domain.split(".")
    for i in range(2, len(labels)):
        if labels[0].islower() and re.fullmatch(r"[A-Z][a-z]*", labels[i]):
            return f"{local}@{'.'.join(labels[:i])}"
    return found


def _address_end(text: str, end: int) -> int:
    sub = _SUB.match(text, end)
    if sub:
        end = sub.end()
    tail = _TAIL.match(text, end)
    if tail:
        words, stop = tail[1].split(" "), tail.end()
        post = _POSTCODE.match(text, stop)
        if not post:
            while len(words) > 1 and (p := _POSTCODE.match(text, tail.start(1) + len(" ".join(words[:-1])))):
                words = words[:-1]
                post = p
            if not post:
                following = text[stop : stop + 12]
                if len(words) > 1 and re.match(r" [a-z0-9]", following) and not (len(words) == 2 and re.match(r" and confirm| and ", following)):
                    words = words[:-1]
                if len(words) > 2:
                    words = words[:2]
                if words[-1] in ("A", "An", "The", "If", "In", "Two", "Three", "Phone"):
                    words = words[:-1] or words
        if words and words[0] not in ("Phone", "Signed", "The", "A", "If"):
            end = tail.start(1) + len(" ".join(words))
            post = _POSTCODE.match(text, end)
            return post.end() if post else end
        return end
    post = _POSTCODE.match(text, end)
    return post.end() if post else end


def detect(source: str | None, scorer: tuple[float, ...] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every occurrence, positions in the source text. ``scorer``: weights of
    names.features, by default those of names.weights."""
    if not source:
        return []
    scorer = weights() if scorer is None else scorer
    aligned = Aligned(source)
    text = aligned.text
    taken = Spans()
    if "@" in text:
        for m in _EMAIL.finditer(text):
            found = _cut_domain(m[0])
            if found.rpartition(".")[2].lower() not in FILE_ENDINGS:
                taken.take_free(m.start(), m.start() + len(found), "email")
    if _DIGIT.search(text):
        numbers = _windows(text, _CLUSTER, 32, 6)
        for m in _within(_IDS, text, numbers):
            before = text[max(0, m.start() - 32) : m.start()]
            start, end = m.span()
            if m["cued"]:
                if not (_ID_CUE.search(before) or (before.endswith("; ") and text[end : end + 1] == ";")):
                    continue
            elif _NOT_ID.search(before):
                continue
            taken.take_free(start, end, "id_number")
        if any(k in text for k in _STREET_WORDS):
            for m in _within(_HEAD, text, _windows(text, _STREET_ANCHOR, 100, 2)):
                taken.take_free(m.start(), _address_end(text, m.end()), "address")
        if any(k in text for k in _CONTINENT_WORDS):
            for m in _CONTINENT.finditer(text):
                taken.take_free(*m.span(), "address")
        if "号" in text:
            for m in _within(_HAN_ADDRESS, text, _windows(text, _NUMBERED, 48, 32)):
                taken.take_free(*m.span(), "address")
        for m in _within(_PHONES, text, numbers):
            if not _NOT_PHONE.search(text[max(0, m.start() - 14) : m.start()]):
                taken.take_free(*m.span(), "phone")
        for m in _within(_PHONE_CUED, text, numbers):
            if 7 <= sum(c.isdigit() for c in m[1]) <= 15:
                taken.take_free(*m.span(1), "phone")
    _detect_names(text, taken, scorer)
    if _HAN_CHAR.search(text):
        _detect_han_names(text, taken)
    out = []
    for a, b, kind in taken.held:
        s, e = aligned.source_span(a, b)
        while s < e and source[s] in " \t\n.,;:，。；：":
            s += 1
        while e > s and source[e - 1] in " \t\n,;:，。；：" or (e > s and source[e - 1] == "." and kind not in ("name", "address")):
            e -= 1
        out.append((kind, s, e))
    return out


def _detect_names(text: str, taken: Spans, scorer: tuple[float, ...]) -> None:
    last_end, pos = -1, 0
    while m := _NAME.search(text, pos):
        start, end = m.span()
        ok = taken.free(start, end)
        if ok:
            words = _NAME_PARTS.split(m[0])
            before = text[max(0, start - 36) : start]
            cued = bool(_BEFORE.search(before)) and not before.endswith("such as ")
            joined = last_end >= 0 and start - last_end < 48 and bool(_JOIN.match(text[last_end:start]))
            ok = is_person(features(text, start, end, cued, bool(_AFTER.match(text, end)), joined, words[0] in _STOP or words[-1] in _STOP), scorer)
        if ok:
            if m[0].endswith(("'s", "’s")):
                end -= 2
            taken.take(start, end, "name")
            last_end = pos = end
        else:
            # a rejected pair may hide a name that starts at its second word
            step = _NEXT_WORD.search(text, start, end)
            pos = step.end() if step else end


def _detect_han_names(text: str, taken: Spans) -> None:
    for pattern in _HAN_PERSON:
        pos = 0
        while m := pattern.search(text, pos):
            start, end = m.span("who")
            if taken.take_free(start, end, "name"):
                pos = end
                # further names of a list
                while (more := _HAN_NEXT.match(text, pos)) and taken.take_free(*more.span("who"), "name"):
                    pos = more.end("who")
            else:
                pos = max(m.start() + 1, start)


def redact(source: str | None, spans: list[tuple[str, int, int]] | None = None) -> str | None:
    """The text with typed placeholders such as ``[EMAIL]`` in place of the spans."""
    if source is None:
        return None
    out, done = [], 0
    for kind, start, end in detect(source) if spans is None else spans:
        out += [source[done:start], f"[{kind.upper()}]"]
        done = end
    return "".join([*out, source[done:]])


def find_pii(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pii_type, start_pos, end_pos): one row per occurrence."""
    kind = dict(documents.dtypes)[key]
    scorer = weights()  # fitted once, on the driver

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *span) for k, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) for span in detect(t, scorer)]
            yield pd.DataFrame(rows, columns=["k", "pii_type", "start_pos", "end_pos"])

    rows = spread(documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")))
    found = rows.mapInPandas(run, f"k {kind}, pii_type string, start_pos int, end_pos int")
    return found.withColumnRenamed("k", key)


def redact_documents(documents: DataFrame, text: str = "text", out: str = "redacted") -> DataFrame:
    """All columns of ``documents`` and the text with placeholders."""

    scorer = weights()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: redact(t, detect(t, scorer)), na_action="ignore")

    return spread(documents).withColumn(out, clean(F.col(f"`{text}`")))
