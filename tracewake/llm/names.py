"""A scored tagger for names of persons (used by problem 9).

Every pair of capitalised words, initial with a word, or short Han string behind
a possible surname is a candidate. A logistic model scores it from the shape,
two Markov chains over letters (names against ordinary words), lists of common
names, the caller's lexicon, the corpus' own lower-case words, and the words
around. It is fitted on all candidates of the corpus and on made-up sentences;
the labels come from names that are known on both sides and from ordinary words.
Half of the training rows go without lists and lexicon, so that unseen names are
judged by form and context. Platt scaling on a held-out part calibrates scores.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

from tracewake.llm import sparse
from tracewake.llm.corpus import Listed, Spread

THRESHOLD = 0.5
#: rows that must have a feature, in the corpus or among the made-up ones
LEAST = 3
SEED = 5
HAN = "一-鿿"

# fixed values: common given and family names, Chinese surnames and characters of given names
FEMALE = "mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy betty sandra margaret ashley emily kimberly donna michelle carol amanda melissa deborah stephanie rebecca laura helen sharon cynthia amy angela anna ruth emma olivia sophia julia jane alice grace rachel claire lucy maria carmen ana isabel lucia elena rosa pilar dolores teresa cristina marta paula sofia petra ursula monika sabine claudia birgit heike anja katrin greta ingrid hanna lena priya fatima aisha yuki mei olga natalia ivana chloe camille".split()
MALE = "james robert john michael david william richard joseph thomas charles christopher daniel matthew anthony mark donald steven paul andrew joshua kenneth kevin brian george edward ronald timothy jason jeffrey ryan jacob gary nicholas eric jonathan stephen larry justin scott brandon benjamin samuel frank peter henry oliver jack harry tom adam luis jose juan carlos miguel antonio manuel francisco javier pedro diego pablo sergio hans klaus jürgen wolfgang stefan andreas matthias markus felix lukas jonas max ahmed omar ravi arjun hiroshi kenji ivan dmitri pierre marco liam noah".split()
FAMILY = "smith johnson williams brown jones miller davis wilson anderson taylor moore jackson martin lee thompson white harris clark lewis robinson walker young allen king wright hill green adams baker nelson carter mitchell roberts turner phillips campbell parker evans edwards collins stewart morris murphy cook rogers morgan cooper peterson bailey reed kelly howard ward cox watson brooks bennett gray hughes foster sanders ross garcia martinez rodriguez lopez hernandez gonzalez perez sanchez ramirez torres flores rivera gomez diaz reyes morales cruz ortiz gutierrez ortega ruiz müller schmidt schneider fischer weber meyer wagner becker schulz hoffmann koch bauer richter klein wolf schröder neumann schwarz zimmermann braun krüger hofmann hartmann lange werner krause lehmann köhler doe patel singh khan kim nguyen tanaka sato ivanov petrov dubois rossi silva santos".split()
ZH_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林罗高郑梁谢宋唐许韩邓冯曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙黎史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常汤康易乔赖文施洪辛柯庄温牛樊葛邢安齐伍祁卞郗阮纪舒屈项祝闵季麻强路娄危童颜梅盛刁骆柴霍虞应宗宣郁单杭包诸左管卓蓝蔺屠蒙池阴鄢景詹束"
#: Han characters that no given name holds
ZH_STOP = frozenset("的是了在和与及或为不有会先再被从到把个这那我你他她它们条件号其后前已未可需要请将并由于但如则即都也就只很更最")
ZH_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉萍红鹏飞辉玲波宇浩凯健俊帆雪琳慧莹佳欣怡婷雅诗涵梓轩子睿博文思远志国建海峰林斌庆荣兰凤洁梅倩颖晨曦阳雨晓丹宁龙彬鑫瑞嘉琪瑶梦然哲安泽昊天翔旭东成亮光良永世宏威力兴全福生振诚康庭岩松柏楠枫桐竹菊莲薇蓉菲芬芸蕾茜萌瑜瑾琼珍珠珊玥璐环小春秋冬月立新民生义仁礼智信德贵富昌盛达正忠根水火土金木石川河岳美香菁妍丰凌"
#: words that begin sentences or stand beside names and are none
ORDINARY = frozenset(
    "the a an in on at by to of and or but for from with without after before during between ask thanks thank see this that these those if when while run add please note dear hello hi hey best kind warm regards sincerely yours cheers sent subject date new old north south east west monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december today tomorrow my our your his her their its he she it we they you who what where how why all any each both only no not yes is are was were will can may "
    "street road avenue lane city state system server service gateway channel team office version release project product manager engineer reviewer owner author contact customer user client company group open data cloud web api "
    "der die das den dem des ein eine und für von mit nach bei ohne bitte im am ich wir sie frau herr herrn grüße grüßen hallo liebe "
    "el la los las un una y de del con por para en según gracias saludos hola señor señora don doña sra sr mr mrs ms dr prof http".split()
)

#: ordinary nouns and adjectives of names of things
NOUNS = "Visual Studio Apache Cassandra Google Maps Amazon Web New York San Francisco Los Angeles Great Britain Open Table Hash Index Load Balancer Final Report Daily Summary Error Message Request Timeout Quick Start Annual Review Blue Ocean Silver Spring Machine Learning Deep Water Power Point Excel Sheet Black Friday Happy Birthday Good Morning Next Steps Known Issues Change Log Release Notes Read Only Data Base Main Street Central Park Red Hat Fire Wall Kubernetes Cluster Postgres Docker Compose Jenkins Pipeline".split()

LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
UP, LOW = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿ"
CAP = rf"(?:[{UP}][{LOW}]+(?:['’-][{UP}][{LOW}]+)*|(?:Mc|Mac|O['’]|D['’])[{UP}][{LOW}]+|[{UP}]{{2,}}(?:['’-][{UP}]{{2,}})*)"
STOP = rf"(?![{LATIN}0-9_(/]|\.[{LATIN}0-9]|['’-][{LATIN}0-9])"
CAPITAL = re.compile(rf"[{UP}](?<![{LATIN}0-9_.'’@/+-].)")
START = re.compile(rf"[{UP}]\. ?|{CAP}(?=,? (?:[{UP}]|(?:van|von|de|der|den|del|la|di|da|dos|zu|bin|al) ))")
PAIR = re.compile(rf"({CAP}) (?:[{UP}]\. ?){{0,2}}({CAP}){STOP}")
PARTICLE = re.compile(rf"({CAP}) (?:(?:van|von|de|der|den|del|la|di|da|dos|zu|bin|al) ){{1,3}}({CAP}){STOP}")
INITIAL = re.compile(rf"([{UP}])\. ?(?:[{UP}]\. ?)?({CAP}){STOP}")
COMMA = re.compile(rf"({CAP}), ({CAP})(?: [{UP}]\.(?! ?[{UP}]))?{STOP}")
COMMA_INITIAL = re.compile(rf"({CAP}), ([{UP}])\.(?: ?[{UP}]\.)?(?![{LATIN}0-9])")
BEFORE_INITIAL = re.compile(rf"{CAP} (?:[{UP}]\. ?)?$")
#: what stands before a place, read backwards
LEFT = re.compile(rf"([^{LATIN}0-9_{HAN}]*)(?:([{LATIN}0-9_]+)|([{HAN}]{{1,2}}))?")
RIGHT = re.compile(rf"([^{LATIN}0-9_{HAN}]{{0,4}})([{LATIN}]+|[0-9]|[{HAN}]{{1,2}})?")
WORD = re.compile(rf"(?<![{LATIN}0-9@._/+-])[{LOW}]{{2,}}+(?![{LATIN}0-9@_/]|[.-][{LATIN}0-9])")
HAN_RUN = re.compile(rf"[{HAN}]{{2,}}")

Record = tuple[str, ...]


def latin_candidates(t: str) -> Iterator[tuple[int, int, Record]]:
    """(start, end, record); overlapping ones too. A record holds form, words and surroundings."""
    end = 0
    for c in CAPITAL.finditer(t):
        a = c.start()
        if a < end or not (m := START.match(t, a)):
            continue
        end = m.end()
        initial = t[a + 1 : a + 2] == "."
        if initial:
            if not BEFORE_INITIAL.search(t, max(0, a - 40), a) and (x := INITIAL.match(t, a)):
                yield _latin(t, x, "initial", x.group(1), x.group(2))
            continue
        if t[m.end()] == ",":
            if x := COMMA.match(t, a):
                yield _latin(t, x, "comma", x.group(2), x.group(1))
            elif x := COMMA_INITIAL.match(t, a):
                yield _latin(t, x, "comma_initial", x.group(2), x.group(1))
        elif x := PAIR.match(t, a):
            yield _latin(t, x, "middle" if ". " in x.group() else "pair", x.group(1), x.group(2))
        elif x := PARTICLE.match(t, a):
            yield _latin(t, x, "particle", x.group(1), x.group(2))


def _latin(t: str, m: re.Match[str], form: str, given: str, family: str) -> tuple[int, int, Record]:
    a, b = m.span()
    word, gap = _left(t[max(0, a - 40) : a])
    head = t[max(0, a - 40) : a - len(gap) - len(word)] if word else ""
    second, _ = _left(head)
    right = RIGHT.match(t, b)
    return a, b, ("latin", form, given, family, word.casefold(), gap[-3:], second.casefold(), right.group(1)[:2], (right.group(2) or "").casefold())


def _left(t: str) -> tuple[str, str]:
    """The last word or two Han characters of a text, and what follows."""
    m = LEFT.match(t[::-1])
    return (m.group(2) or m.group(3) or "")[::-1], m.group(1)[::-1]


def han_candidates(t: str, surnames: frozenset[str], cues: re.Pattern[str] | None, common: frozenset[str] = frozenset(), given: frozenset[str] = frozenset()) -> Iterator[tuple[int, int, Record]]:
    """Two or three Han characters behind a possible surname, or at a word learned to stand beside names if they are no common words.

    With given, also those whose characters behind the first all belong to it.
    """
    for run in HAN_RUN.finditer(t):
        lo, hi = run.span()
        starts = {i for i in range(lo, hi - 1) if t[i] in surnames or t[i : i + 2] in surnames}
        ends: set[int] = set()
        if given:
            starts |= {i for i in range(lo, hi - 1) if t[i + 1] in given and (i + 2 == hi or t[i + 2] in given)}
        if cues:
            back = max(0, lo - 3)
            for m in cues.finditer(t, back, min(len(t), hi + 3)):
                if lo <= m.end() < hi - 1:
                    starts.add(m.end())
                if lo + 1 < m.start() <= hi:
                    ends.add(m.start())
            if lo and cues.search(t[back:lo].rstrip(" ")):
                starts.add(lo)
        spans = {(a, a + n) for a in starts for n in (2, 3, 4) if a + n <= hi and (n < 4 or t[a : a + 2] in surnames)}
        spans |= {(e - n, e) for e in ends for n in (2, 3) if e - n >= lo}
        usual = lambda x: any(c in ZH_STOP for c in x) or x[:2] in common or x[-2:] in common
        spans = {(a, b) for a, b in spans if not (usual(t[a:b]) if t[a] not in surnames and t[a : a + 2] not in surnames else any(c in ZH_STOP for c in t[a + 1 : b]))}
        for a, b in sorted(spans):
            left, right = t[max(0, a - 4) : a].rstrip(" "), t[b : b + 4].lstrip(" ")
            yield a, b, ("han", str(b - a), t[a:b], left[-2:], right[:2], str(int(a == lo)), str(int(b == hi)))


class Chain:
    """Letter bigrams of names against ordinary words; the mean log ratio of a word."""

    def __init__(self, names: Iterable[str], words: Iterable[str]):
        a, b = self._count(names), self._count(words)
        na, nb = Counter(), Counter()
        for (x, _), n in a.items():
            na[x] += n
        for (x, _), n in b.items():
            nb[x] += n
        self.ratio = {k: math.log((a[k] + 0.3) / (na[k[0]] + 9)) - math.log((b[k] + 0.3) / (nb[k[0]] + 9)) for k in a.keys() | b.keys()}

    @staticmethod
    def _count(words: Iterable[str]) -> Counter[tuple[str, str]]:
        out: Counter[tuple[str, str]] = Counter()
        for w in words:
            s = f"^{w}$"
            out.update(zip(s, s[1:], strict=False))
        return out

    def score(self, w: str) -> float:
        s = f"^{w}$"
        return sum(self.ratio.get(k, 0.0) for k in zip(s, s[1:], strict=False)) / (len(s) - 1)


@dataclass
class Tagger:
    given: frozenset[str]
    family: frozenset[str]
    zh_family: frozenset[str]
    zh_given: frozenset[str]
    vocabulary: frozenset[str]
    zh_common: frozenset[str]
    chain: Chain
    weights: dict[str, float] = field(default_factory=dict)
    platt: tuple[float, float] = (1.0, 0.0)
    cues: str = ""

    def ready(self) -> Tagger:
        self.pattern = re.compile(self.cues) if self.cues else None
        self.surnames = frozenset(ZH_FAMILY) | self.zh_family
        return self

    def label(self, r: Record) -> int | None:
        """1 for names known on both sides, 0 for ordinary words, None where neither is sure."""
        if r[0] == "han":
            n = r[2]
            k = 2 if n[:2] in self.zh_family else 1
            if n[:2] in self.zh_common:
                return 0
            if n[:k] not in self.zh_family or len(n) <= k or n[k] not in self.zh_given:
                return None
            if all(c in self.zh_given for c in n[k:]):  # a part of a longer known name teaches nothing
                return None if len(n) == k + 1 and r[4][:1] in self.zh_given else 1
            return 0 if n[-1] + r[4][:1] in self.zh_common else None
        g, f = r[2].casefold(), r[3].casefold()
        if any(len(w) > 1 and (w in ORDINARY or w in self.vocabulary) for w in (g, f)):
            return 0
        if f in self.family or f in _FAMILY:
            return 1 if len(g) == 1 or g in self.given or g in _GIVEN else None
        return None

    def features(self, r: Record, lists: bool = True) -> list[str]:
        if r[0] == "han":
            return self._han_features(r, lists)
        _, form, given, family, l1, gap, l2, punct, r1 = r
        g, f = given.casefold(), family.casefold()
        out = ["bias", f"form:{form}", f"l1:{l1}{gap.strip()}", f"l2:{l2} {l1}", f"gap:{gap}", f"r1:{punct.strip()}{r1}", f"rp:{punct[:1]}", f"caps:{given.isupper() and len(given) > 1}{family.isupper()}"]
        if given.isupper() != family.isupper() and len(given) > 1:
            out.append("mixed")
        for role, w in (("g", g), ("f", f)):
            if len(w) == 1:
                continue
            out += [f"{role}chain:{max(-4, min(4, round(self.chain.score(w) * 4)))}", f"{role}len:{min(len(w), 9)}"]
            if lists:
                if w in self.vocabulary:
                    out.append(f"{role}word")
                if w in ORDINARY:
                    out.append(f"{role}ordinary")
                if w in self.given or w in _GIVEN:
                    out.append(f"{role}given")
                if w in self.family or w in _FAMILY:
                    out.append(f"{role}family")
        if not lists:
            out.append("unlisted")
        elif not {"gword", "fword", "gordinary", "fordinary"} & set(out):
            out.append("rare")
        return out

    def _han_features(self, r: Record, lists: bool) -> list[str]:
        _, n, name, left, right, at_start, at_end = r
        k = 2 if name[:2] in self.zh_family else 1
        out = ["zbias", f"zn:{n}", f"zl2:{left}", f"zl1:{left[-1:]}", f"zr2:{right}", f"zr1:{right[:1]}", f"zedge:{at_start}{at_end}", f"zn_edge:{n}{at_end}"]
        if lists:
            known = sum(c in self.zh_given or c in _ZH_GIVEN for c in name[k:])
            out += [f"zgiven:{known}/{len(name) - k}", f"zfam:{int(name[:k] in self.zh_family)}{int(name[:1] in _ZH_FAMILY)}"]
            if name[:2] in self.zh_common:
                out.append("zword")
            if name[1:3] in self.zh_common:
                out.append("zword2")
            if name[-1] + right[:1] in self.zh_common:
                out.append("zcut")
            if left[-1:] + name[0] in self.zh_common:
                out.append("zcut_left")
            if right in self.zh_common:
                out.append("znext")
        return out

    def logit(self, r: Record) -> float:
        return self.platt[0] * sum(self.weights.get(x, 0.0) for x in self.features(r)) + self.platt[1]

    def score(self, r: Record) -> float:
        """Calibrated probability."""
        return sparse.probability(self.logit(r))

    def names(self, t: str) -> list[tuple[int, int]]:
        """Spans of names; of overlapping ones the likelier."""
        found = [(self.logit(r), a, b) for a, b, r in latin_candidates(t)]
        if not t.isascii():
            found += [(self.logit(r), a, b) for a, b, r in han_candidates(t, self.surnames, self.pattern, self.zh_common)]
        unlisted = lambda a: t[a] >= "一" and t[a] not in self.surnames and t[a : a + 2] not in self.surnames
        good = sorted(((p, a, b) for p, a, b in found if p >= math.log(THRESHOLD / (1 - THRESHOLD))), key=lambda x: (unlisted(x[1]), -x[0], x[1], -x[2]))
        kept: list[tuple[int, int]] = []
        for _, a, b in good:
            if not any(a < d and c < b for c, d in kept):
                kept.append((a, b))
        return kept


_GIVEN, _FAMILY = frozenset(FEMALE) | frozenset(MALE), frozenset(FAMILY)
#: ordinary characters around names in made-up sentences
_ZH_FILL = "人到来去说看问给找对把请让要会能已经通知收发送查改用做开关上下中里外今昨天次回办交付签取寄退订"
_ZH_FAMILY, _ZH_GIVEN = frozenset(ZH_FAMILY), frozenset(ZH_GIVEN)


def common_words(t: str) -> set[str]:
    """Lower-case words of a text and the Han pairs that begin like a surname."""
    out = set(WORD.findall(t))
    if t.isascii():
        return out
    for run in HAN_RUN.findall(t):
        out.update(run[i : i + 2] for i in range(len(run) - 1))
    return out


def made_up_sentences() -> list[tuple[str, list[tuple[int, int]]]]:
    """Sentences from a seeded generator with the spans of their names."""
    r = random.Random(SEED)
    after: dict[str, list[str]] = {}
    for w in FEMALE + MALE + FAMILY:
        for k in range(len(w) + 1):
            after.setdefault(("^^" + w)[k : k + 2], []).append((w + "$")[k])

    def invented() -> str:
        """A name from letter trigrams of the lists."""
        while True:
            w = "^^"
            while len(w) < 14 and (c := r.choice(after[w[-2:]])) != "$":
                w += c
            if len(w) > 5:
                return w[2:].title()

    usual = sorted(ORDINARY)
    latin = (
        "Kind wishes,\n{n}", "cc {n} and the others", "Author: {n}\n", "Dear {n},\nthe parcel came", "I spoke with {n} about it.", "{n} said that it works.", "Assigned to {n}.", "We met {n} yesterday.", "Owner: {n}", "the invoice of {n} is late", "Call {n} at noon", "ask {n} first", "{n} (billing) agreed",
        "geprüft von {n}.", "Viele Grüße\n{n}", "Ansprechpartner: {n}", "laut {n} ist es fertig", "Un saludo, {n}", "según {n}, falta una firma", "Responsable: {n}", "Mr. {n} called", "Dr. {n} signed", "- {n}\n", "user {n} logged in", "To: {n} <x@y.example>", "approved by {n}, closed", "{n}\nSenior Engineer", "names: {n}; {n}", "客户 {n} 来电",
    )
    other = (
        "The {w} {w} is down.", "see {w} {w} for details", "## {w} {w}\n", "Our {w} {w} team", "{w}, {w} and more", "In {w} {w} we trust", "a {w} {w} rollout", "{w} {w} failed at noon", "Der {w} {w} ist da", "El {w} {w} falla", "Ask {w} {w}", "use {w} {w}.", "- {w} {w} 2.0", "({w} {w})", "from {w} {w} to {w} {w}", "{w}: {w} {w}",
    )
    out = []
    for _ in range(1500):
        given = r.choice(FEMALE + MALE).title() if r.random() < 0.6 else invented()
        family = r.choice(FAMILY).title() if r.random() < 0.5 else invented()
        form = r.random()
        n = f"{given} {family}" if form < 0.7 else f"{given[0]}. {family}" if form < 0.8 else f"{family}, {given}" if form < 0.88 else f"{given} {r.choice('ABCDEJKLMRS')}. {family}" if form < 0.95 else f"{given} {family}".upper()
        out.append(_filled(r.choice(latin), "{n}", n))
        w = r.choice(other)
        while "{w}" in w:
            w = w.replace("{w}", r.choice(NOUNS), 1)
        out.append((w, []))
    for _ in range(1200):  # surroundings that tell nothing
        left, right = (" ".join(r.choice(usual) for _ in range(r.randint(0, 2))) for _ in range(2))
        gap, end = r.choice(("", "", ", ", ": ", " - ")), r.choice(("", "", ".", ",", "!", "\n", ")"))
        n = f"{r.choice(FEMALE + MALE).title() if r.random() < 0.3 else invented()} {r.choice(FAMILY).title() if r.random() < 0.3 else invented()}"
        text, spans = _filled(f"{left}{gap or ' ' if left else ''}{{n}}{end} {right}", "{n}", n)
        out.append((text, spans))
        w = [r.choice((r.choice(NOUNS), r.choice(usual).title())) for _ in range(2)]
        out.append((f"{left}{gap or ' ' if left else ''}{' '.join(w)}{end} {right}", []))
    zh = ("客户{n}反馈无法登录", "请联系{n}处理", "由{n}负责跟进", "{n}说明天上线", "经理{n}已同意", "{n}先生来电", "感谢{n}的支持", "昨天与{n}沟通过", "负责人：{n}。", "抄送{n}、其他人", "{n}女士的订单", "已转给{n}，请查收", "同事{n}（财务）", "{n}认为可以", "签字：{n}\n")
    words = "方法 任务 周期 程序 成功 金额 时间 高级 安全 文件 文档 白天 马上 平台 路径 项目 连接 计划 单元 应用 常见 江苏 全部 温度 管理 费用 解决 严重 支付 余额 关系 向下 易用 曾经 空间 国家 华为 东西 充值 包含 强制 万一 施工 钱包 牛奶 龙头 雷达 石头 毛利 夏天 方案 任何 周一 单号 应该 安装 左边 路由 池子 管道 包装 单位 文本 金融 时候 常量 连续 项链 强度 成本 平均 高峰 解析 计算 严格".split()
    negative = ("这个{w}很重要", "请检查{w}处理结果", "由{w}负责", "{w}说明如下", "与{w}有关", "感谢{w}的支持", "客户{w}反馈", "请联系{w}组", "已转给{w}，请查收", "{w}认为", "没有{w}。", "更新{w}，重启")
    for _ in range(900):
        n = r.choice(ZH_FAMILY) + "".join(r.choice(ZH_GIVEN) for _ in range(r.choice((1, 2, 2))))
        out.append(_filled(r.choice(zh), "{n}", n))
        out.append((r.choice(negative).replace("{w}", r.choice(words)), []))
        if r.random() < 0.6:
            continue
        around = [r.choice(("", "，", "：", "。")) + "".join(r.choice(_ZH_FILL) for _ in range(r.randint(0, 3))) for _ in range(2)]  # surroundings that tell nothing
        n = r.choice(ZH_FAMILY) + "".join(r.choice(ZH_GIVEN) for _ in range(r.choice((1, 2, 2))))
        out.append((f"{around[0]}{n}{around[1]}", [(len(around[0]), len(around[0]) + len(n))]))
        out.append((f"{around[0]}{r.choice(words)}{around[1]}", []))
    return out


def _filled(template: str, hole: str, name: str) -> tuple[str, list[tuple[int, int]]]:
    spans = []
    while hole in template:
        a = template.index(hole)
        template = template.replace(hole, name, 1)
        spans.append((a, a + len(name)))
    return template, spans


def least_texts(docs: int) -> int:
    """Texts that must hold a word before it counts as ordinary: a share of all, or names written small now and then would join them as a corpus grows."""
    return max(3, docs // 1300)


def train(lexicon: list[tuple[str, str, str]], records: list[Record] | Spread, words: list[tuple[str, int]], docs: int) -> Tagger:
    """Fits the model. records and words come from docs texts; words with the number of texts that hold them."""
    corpus = records if isinstance(records, Spread) else Listed(records)
    part = lambda p, zh: frozenset((n if zh else n.casefold()) for n, q, s in lexicon if q == p and (s == "zh") == zh)
    known = part("given", False) | part("family", False) | _GIVEN | _FAMILY
    least = max(3, docs // 500)
    vocabulary = frozenset(w for w, n in words if n >= least_texts(docs) and w.isascii() | (not HAN_RUN.match(w)) and w not in known)
    zh_common = frozenset(w for w, n in words if n >= least and HAN_RUN.match(w) and not (w[0] in part("family", True) and w[1] in part("given", True)))
    base = frozenset(w.casefold() for k, w in enumerate(NOUNS) if k % 4) - known  # the others are judged by context
    vocabulary |= base
    chain = Chain(sorted(known), sorted(vocabulary | ORDINARY))
    tagger = Tagger(part("given", False), part("family", False), part("family", True), part("given", True), vocabulary, zh_common, chain).ready()
    _grow(tagger, corpus)
    made_up = _made_up_records(tagger.surnames)
    _fit(tagger, corpus, _label, made_up)
    # names found with confidence beside several others join the known ones, and the fit is repeated with all sure records
    first, parts = tagger, corpus.shared(_sure_parts, tagger, 3)
    new = [frozenset(p for g, p in parts if g == group) for group in ("given", "family", "zh_given", "zh_family")]
    tagger = replace(first, given=first.given | new[0], family=first.family | new[1], zh_given=first.zh_given | new[2], zh_family=first.zh_family | new[3]).ready()
    begun = frozenset(p for _, p in corpus.shared(_whole_and_begun, (first, tagger), 2))
    _fit(tagger, corpus, _label_or_sure, made_up, first, begun)
    return tagger


def _made_up_records(surnames: frozenset[str]) -> list[tuple[Record, int]]:
    made_up = []
    for text, spans in made_up_sentences():
        made_up += [(r, int((a, b) in spans)) for a, b, r in latin_candidates(text)]
        for a, b, r in han_candidates(text, surnames, None):
            if (a, b) in spans or not any(c <= a and b <= d for c, d in spans):  # a part of a name teaches nothing
                made_up.append((r, int((a, b) in spans)))
    return made_up


def _grow(tagger: Tagger, corpus: Listed | Spread, least: int = 3) -> None:
    """Han characters that end runs beside known parts of names, in several names, join the known ones."""
    for _ in range(2):
        got = corpus.shared(_run_ends, tagger, least)
        third, first = (frozenset(p for g, p in got if g == group) for group in ("third", "first"))
        tagger.zh_given |= third - ZH_STOP
        tagger.zh_family |= first - ZH_STOP - third - tagger.zh_given
        tagger.ready()


def _run_ends(tagger: Tagger, r: Record) -> Iterator[tuple[str, str, str]]:
    if r[0] != "han" or r[6] != "1" or len(r[2]) != 3:
        return
    n = r[2]
    if n[0] in tagger.surnames and n[1] in tagger.zh_given and n[1:] not in tagger.zh_common:
        yield "third", n[2], n[:2]
    if all(c in tagger.zh_given for c in n[1:]) and n[:2] not in tagger.zh_common:
        yield "first", n[0], n[1:]


def _sure(first: Tagger, r: Record) -> float | None:
    """The score of a record without label, if it is a clear one."""
    return p if first.label(r) is None and not 0.05 < (p := first.score(r)) < 0.9 else None


def _sure_parts(first: Tagger, r: Record) -> Iterator[tuple[str, str, str]]:
    """Which part, itself and its partner: given and family name, last Han character and Han surname of a sure name."""
    if (_sure(first, r) or 0) < 0.9:
        return
    if r[0] == "han":
        yield "zh_given", r[2][-1], r[2][:-1]
        yield "zh_family", r[2][0], r[2][1:]
    elif r[1] != "particle":
        g, f = r[2].casefold(), r[3].casefold()
        if len(g) > 2:
            yield "given", g, f
        if len(f) > 2:
            yield "family", f, g


def _whole_and_begun(taggers: tuple[Tagger, Tagger], r: Record) -> Iterator[tuple[str, str, str]]:
    """Whole Han names, and what sure ones are with the next character."""
    first, tagger = taggers
    if r[0] != "han":
        return
    sure = (_sure(first, r) or 0) >= 0.9
    if tagger.label(r) or (sure and len(r[2]) == 3):
        yield "", r[2], "whole"
    if sure:
        yield "", r[2] + r[4][:1], "begun"


def _label(state: _State, r: Record) -> int | None:
    return state.tagger.label(r)


def _label_or_sure(state: _State, r: Record) -> int | None:
    if (y := state.tagger.label(r)) is not None:
        return y
    p = _sure(state.first, r)
    return None if p is None else int(p >= 0.9 and not (r[0] == "han" and r[2] + r[4][:1] in state.begun))


@dataclass
class _State:
    """What the examples of a fit are made with."""

    tagger: Tagger
    label: Callable[[_State, Record], int | None]
    first: Tagger | None
    begun: frozenset[str]
    index: dict[str, int] = field(default_factory=dict)


def _seen(state: _State, r: Record) -> Iterator[tuple[str, ...]]:
    """Features of an example, with and without lists, the number of features of its longest row, and its surroundings for cue words."""
    if (y := state.label(state, r)) is None:
        return
    for lists in (True, False):
        fs = state.tagger.features(r, lists)
        yield from (("feature", f) for f in dict.fromkeys(fs))
        yield "width", str(len(fs))
    if r[0] == "han":
        yield from (("good" if y else "bad", c) for c in ((r[3], r[4]) if y else (r[3], r[4], r[3][-1:])))
        if y:
            yield "good", r[3][-1:]


def _rows(state: _State, r: Record) -> Iterator[tuple[tuple[int, ...], int, bool]]:
    if (y := state.label(state, r)) is not None:
        for lists in (True, False):
            fs = state.tagger.features(r, lists)
            yield from [(sparse.number(fs, state.index), y, sparse.is_held(fs))] * 2  # as much as two made-up ones


def _fit(tagger: Tagger, corpus: Listed | Spread, label: Callable[[_State, Record], int | None], made_up: list[tuple[Record, int]], first: Tagger | None = None, begun: frozenset[str] = frozenset()) -> None:
    """Weights and calibration from all examples, each once with and once without lists, and cue words from the corpus' own."""
    state = _State(tagger, label, first, begun)
    invented = [(tagger.features(r, lists), y) for r, y in made_up for lists in (True, False)]
    kept = {f for f, n in Counter(f for fs, _ in invented for f in set(fs)).items() if n >= LEAST}
    good, bad, width = Counter(), Counter(), max(len(fs) for fs, _ in invented)
    for (kind, x), n in corpus.count(_seen, state, LEAST).items():
        if kind == "feature":
            kept.add(x)
        elif kind == "width":
            width = max(width, int(x))
        else:
            (good if kind == "good" else bad)[x] += n
    state.index = {f: k for k, f in enumerate(sorted(kept))}
    local = sparse.blocks((sparse.number(fs, state.index), y, sparse.is_held(fs)) for fs, y in invented)
    found = corpus.blocks(_rows, state)
    tagger.weights, tagger.platt = sparse.solve(lambda f: f(local) + found(f), state.index, width)
    cue = {c for c, n in good.items() if c and n >= 8 and n > 0.4 * (n + bad[c]) and not c.isspace() and any("一" <= x <= "鿿" for x in c)}
    tagger.cues = "|".join(re.escape(c) for c in sorted(cue, key=lambda c: (-len(c), c)))
    tagger.ready()
