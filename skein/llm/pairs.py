"""Prompt and response pairs that are broken, with the kind of defect.

Two statistics of the whole corpus support the judgement of a cut reply: replies sorted by text, where a reply that is
the beginning of its neighbour is a shortened version; and the lengths at which many replies stop without an end (spikes of a length
limit). A third, how often a word ends a sentence where it occurs, tells an unpunctuated end from a cut. Copy, refusal and language
rules follow per row. Patterns are word lists per language.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import is_blank
from skein.operators.joins import checked
from skein.session import ensure_checkpoint_dir

END = re.compile(r"[.!?。！？…][\"'”’»」』）)\]*_]*$")
CITED = re.compile(r"(?:\s*\[\d+\])+$")
ADDRESS = re.compile(r"(?:https?://|www\.)\S+$")
ITEM = re.compile(r"^\s*(?:\d+[.)、]|[-*•])\s+")
FENCE = "```"
#: A sentence with its end.
ENDED = re.compile(r"[^.!?。！？]*[.!?。！？]")
WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
QUANTITY = re.compile(r"^\W*\d+([.,:]\d+)?\s*\W?\s*([^\W\d_]+\s?){0,3}\W*$")

#: Sentences that decline, by language.
REFUSALS = {
    "en": "|".join(
        [
            r"\b(can ?not|can['’]?t|won['’]?t|unable to|not able to|not allowed to|not permitted to|not in a position to) (help|assist|answer|comment|respond|discuss|provide|give|share|talk|go into|do that|say)\b",
            r"\b(must|have to|will|prefer to) (decline|refuse)\b",
            r"\bnot a topic i can\b|\bsomething i (won['’]?t|can['’]?t|can ?not|will not)\b|\bcan ?not comment\b",
            r"\b(guidelines|policy|policies|rules|terms of (use|service))\b.*\b(prevent|forbid|prohibit|do not allow|don['’]t allow)\b|\b(prevent|forbid|prohibit)s? me from\b",
            r"\bagainst (the|my|our) (terms|guidelines|rules|polic)",
            r"\b(beyond|outside) (my|the) (remit|scope|responsibilit)|\bleave the question open\b",
            r"\bnot contain (enough|sufficient) (evidence|information)|\b(not enough|insufficient|no sufficient) (evidence|information)\b|\bno reliable (conclusion|answer)\b|\bno (answer|conclusion) can be given\b",
            r"\bi do(n['’]t| not) have (access|enough|any information|information)\b|\bi do(n['’]t| not) know\b",
            r"\b(nothing|no (document|file|source|record|page|article|passage|entry|information|data|material|mention)s?) (in|of|on|about|covers?|mentions?|describes?|addresses|was found|is available)\b",
            r"\b(documents?|files?|sources?|records?|material|knowledge base|index) (say|says|contain|contains|hold|holds|have|has|mention|mentions|tell|tells) (nothing|no )|\bno answer is possible\b|\b(would|could|can) only (be guessing|guess|speculate)\b",
            r"\b(i['’]?d|i would) (rather|prefer) not\b|\b(outside|beyond) (of )?what i\b|\bnot (for me|mine) to (say|answer|discuss|judge)\b|\b(can ?not|can['’]?t|could not|couldn['’]?t) find (anything|any|an answer|the answer|it)\b",
        ]
    ),
    "zh": r"无法(回答|提供|给出|得出|协助|帮助|处理|讨论|告知)|不(便|能|可以|予|方便)(回答|讨论|提供|透露|告知|协助|谈论|评论)|恕(不|难|无法)|拒绝(回答|提供)|超出了?(我|本|服务|系统).{0,6}(范围|职责|权限|能力)|没有足够的?(证据|信息|资料)|未找到(相关|足够)|爱莫能助|(查|找|搜索|检索)不到|没有办法(作答|回答|答复|提供|给出)|没法(回答|作答|提供)|(没有|未|无)(提到|提及|记载|收录|记录|涉及)|没有(相关|任何|对应)的?(资料|信息|内容|记录|文档|依据)|不(在|属于)(我|本|服务).{0,8}(范围|职责|权限)|(不归|轮不到)我|无可奉告|不足以(回答|作答|得出)|只能(靠)?(猜|推测)|抱歉，?(我)?(无法|不能|帮不)",
    "de": r"\b(kann|darf|werde|möchte|will) ich\b[^.!?]*\b(nicht|keine?n?)\b[^.!?]*\b(helfen|weiterhelfen|beantworten|antworten|geben|auskunft|sagen|äußern|eingehen|besprechen|unterstützen)|\bleider (keine|nicht)\b|\b(muss|möchte) ich (leider )?(ablehnen|verweigern)|\bich (kann|darf|werde|möchte)\b[^.!?]*\b(nicht|keine?n?)\b[^.!?]*\b(helfen|weiterhelfen|beantworten|antworten|geben|auskunft|sagen|äußern|eingehen|besprechen)|\bmuss ich\b[^.!?]*\bablehnen\b|\b(anfrage|frage|bitte) (muss|kann)\b[^.!?]*\b(ablehnen|nicht beantwort)|\b(nicht genug|nicht genügend|keine ausreichenden?|zu wenig|nicht ausreichend)\b[^.!?]*\b(belege|nachweise|informationen|hinweise|evidenz|angaben)|\bverstößt gegen\b|\bverstieße gegen\b|\b(außerhalb|jenseits) meine[rs]\b|\brichtlinien\b[^.!?]*\b(verbieten|untersagen|hindern|erlauben)|\b(liegen|liegt|habe|finde|fand|gibt es)\b[^.!?]*\bkeine?n?\b[^.!?]*\b(angaben?|informationen|unterlagen|daten|auskunft|hinweise?|eintr[aä]ge?|treffer)\b|\bgehört nicht zu (meine|den)\b|\b(unterlagen|dokumente|quellen|dateien|wissensbasis|angaben)\b[^.!?]*\b(nichts|reichen[^.!?]*nicht|erwähnen[^.!?]*(nicht|keine?n?)|enthalten (nichts|keine?n?)|sagen (nichts|dazu nichts))\b|\bkeine antwort (möglich|geben)\b|\b(könnte|kann) ich nur (raten|vermuten)\b|\bich weiß (es |das )?nicht\b",
    "es": r"\bno (puedo|podemos|podré|es posible|me es posible|estoy autorizad[oa]|me está permitido|tengo permitido|voy a|debo)\b[^.!?]*\b(ayudar|ayudarle|responder|contestar|dar|ofrecer|proporcionar|comentar|hablar|tratar|compartir|asistir)|\b(debo|tengo que|prefiero|he de) (rechazar|declinar|negarme|no)\b|\b(fuera|más allá) de (mi|mis)\b|\bno (hay|contiene|contienen|existe|existen|se dispone de|dispongo de|tengo)\b[^.!?]*\b(suficientes?|acceso|pruebas|evidencias?|información)|\b(normas|directrices|condiciones|políticas?)\b[^.!?]*\b(impiden|prohíben|no (me )?permiten)|\b(va|iría|irían|iria) (en contra|contra)\b|\bincumpl|\bqueda fuera de\b|\bfuera de lo que (puedo|debo|me)\b|\b(documentos?|archivos?|fuentes?|base de conocimientos?|registros?)\b[^.!?]*\bno (mencionan?|dicen?|recogen?|contienen?|hablan?|incluyen?|bastan?|alcanzan?|aclaran?)\b|\bno (encuentro|encontré|he encontrado|figura|consta|aparece) (nada|ning|en)|\bno hay (una )?(respuesta|datos|constancia)|\bnada (sobre|acerca de|en los)\b|\bprefiero no\b|\bno me corresponde\b|\bno es (cosa|asunto) mío\b|\bsolo (podría|puedo) (adivinar|suponer|especular)|\bno lo sé\b",
}
REFUSAL = {name: re.compile(pattern, re.I) for name, pattern in REFUSALS.items()} | {None: re.compile("|".join(REFUSALS.values()), re.I)}
#: Sentences that add nothing to a refusal.
COURTESY = re.compile(
    r"^\W*(hello|hi|hey|thank|thanks|sorry|apolog|please|is there|feel free|anything|i understand|understood|if you have|let me know|i hope|you (can|may|could)|maybe|perhaps|try |contact|ask "
    r"|您好|你好|我(理解|明白|知道)|明白|抱歉|对不起|感谢|谢谢|请|您可以|你可以|如有|如果您|还有|希望|建议"
    r"|hallo|guten|ich verstehe|danke|vielen dank|entschuldig|tut mir|es tut mir|bitte|gern|kann ich sonst|gibt es|fragen sie|sie können|wenden sie|möchten sie"
    r"|hola|buen|entiendo|comprendo|gracias|perdón|disculp|lo siento|lamento|por favor|puede|pregunte|consulte|si (lo )?(desea|necesita)|¿(hay|puedo|necesita|desea|quiere)|¡)",
    re.I,
)
#: Words that repeat a question without adding to it.
ECHO = set("you say said asked ask are asking is it your the a question about so i see to repeat understand want know was 您 问 的 是 问题 想 你 请 关 于 吗 sie fragen frage ihre haben gefragt also die usted pregunta su es la pregunto preguntaba dice".split())

NAMES = {
    "en": r"english|englisch|inglés|ingles|英文|英语",
    "zh": r"chinese|chinesisch|chino|mandarin|中文|汉语|普通话",
    "de": r"german|deutsch|alemán|aleman|德文|德语",
    "es": r"spanish|spanisch|español|espanol|castellano|西班牙(文|语)",
}
ASKS = re.compile(r"answer|reply|respond|write|translat|antwort|schreib|übersetz|contest|respond|escrib|traduz|traduc|回答|回复|答复|翻译|作答", re.I)
FUNCTION_WORDS = {
    "en": set("the of and to is are in for with that this it be by an a not on as at from has have had was were will should must can may which because when if or until since before after without under then been its our your they not how what who why does do please into also more".split()),
    "de": set("der die das und ist nicht mit den dem des ein eine einen einer im für von zu auf wie wenn was wer wird werden kann muss darf soll sollte hat haben bei nach vor über aus sich auch oder als durch bis seit weil kein keine ohne danach dass sind wurde falls bitte binnen sobald".split()),
    "es": set("el la los las de del y es no con un una en para por que se al su lo como si más cuando qué quién cómo está son debe puede sin hasta desde porque sobre entre tras luego también fue era falta cada hay tiene después antes todas".split()),
}


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


CODE = re.compile(r"```.*?(```|$)|https?://\S+|`[^`]*`", re.S)
UMLAUT, ACCENT = re.compile(r"[äöüß]", re.I), re.compile(r"[ñ¿¡áíó]", re.I)


def language(text: str, found: list[str] | None = None) -> str | None:
    """en, de, es or zh; None if there are too few signs. found are the words of the text, if they are known."""
    if "`" in text or "://" in text:
        text, found = CODE.sub(" ", text), None
    found = words(text) if found is None else found
    if not found:
        return None
    wide = sum("一" <= w <= "鿿" for w in found)
    if wide >= 4 and wide > 0.5 * len(found):
        return "zh"
    if wide > 0.3 * len(found) or len(found) < 3:
        return None
    extra = {"de": 2 if UMLAUT.search(text) else 0, "es": 2 if ACCENT.search(text) else 0}
    votes = sorted(((sum(map(known.__contains__, found)) + extra.get(name, 0), name) for name, known in FUNCTION_WORDS.items()), reverse=True)
    return votes[0][1] if votes[0][0] >= 2 and votes[0][0] >= votes[1][0] + 2 or votes[0][0] >= 3 and votes[0][0] > votes[1][0] * 1.5 else None


def wanted_language(prompt: str) -> str | None:
    if ASKS.search(prompt):
        for name, pattern in NAMES.items():
            if re.search(pattern, prompt, re.I):
                return name
    return language(prompt)


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?。！？])\s*(?=\S)|\n+|\s+[—–]\s+(?=[A-ZÄÖÜ])", text) if WORD.search(s)]


def is_refusal(prompt: str, reply: str, spoken: str | None = None) -> bool:
    """Declines, and says nothing else but courtesies and the question. The first sentence that says something ends the
    test, so a long answer costs no more than its beginning. spoken is the language of the reply, if it is known."""
    own, refused, declines = None, False, REFUSAL[spoken]
    for s in sentences(reply):
        if declines.search(s):
            refused = True
        elif not (COURTESY.search(s) or len(said := words(s)) <= 4):
            own = " ".join(words(prompt)) if own is None else own
            if " ".join(said) not in own:
                return False
    return refused


def is_copy(prompt: str, reply: str, said: list[str] | None = None) -> bool:
    """Nothing beyond the question: all of it, or nearly all, and no new words but echoing ones."""
    asked, said = words(prompt), words(reply) if said is None else said
    if not asked or not said:
        return False
    own = set(asked)
    new = sum(w not in own and w not in ECHO for w in said)
    if new > max(1, 0.1 * len(said)) and new > 0.1 * len(asked):
        return False
    return len(own & set(said)) >= 0.6 * len(own) and len(said) >= 0.6 * len(asked)


def last_words(text: str) -> list[str]:
    """What each beginning of a text ends with: its last word, or its last two ideographs."""
    found = WORD.findall(text.lower())
    return [found[i - 1] + w if i and "一" <= w <= "鿿" else w for i, w in enumerate(found)]


def last_word(text: str) -> str | None:
    """What a text ends with, without citations and marks: its last word, or its last two ideographs."""
    found = last_words(CITED.sub("", text.strip()))
    return found[-1] if found else None


def ending(reply: str) -> str:
    """How a reply ends: 'end' complete, 'short' a bare answer, 'item' in an unpunctuated item of a list,
    'open' else."""
    text = reply.rstrip()
    if text.count(FENCE) % 2 or re.search(r"(^|\n)\s*\d+[.)、]$", text):
        return "open"
    bare = CITED.sub("", text).rstrip()
    if END.search(text) or END.search(bare) or text.endswith(FENCE) or ADDRESS.search(text) or bare != text:
        return "end"
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return "end"
    if ITEM.match(lines[-1]):
        return "item"
    if len(lines) == 1:
        n = len(words(text))
        if QUANTITY.match(text) or n == 1 or (len(text) <= 6 and "一" <= text[0] <= "鿿"):
            return "end"
        if n <= 5:
            return "short"
    return "open"


def _features(df: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for prompt, reply in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                said = words(reply)
                want, have = wanted_language(prompt), language(reply, said)
                copy, refusal = is_copy(prompt, reply, said), is_refusal(prompt, reply, have)
                ends = ending(reply)
                rows.append((copy, refusal, bool(want and have and want != have), ends, last_word(reply), have or ""))
            c = list(zip(*rows)) or [[]] * 6
            kinds = [pa.bool_(), pa.bool_(), pa.bool_(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(x), k) for x, k in zip(c, kinds))], names=["id", "prompt", "reply", "copy", "refusal", "other_language", "ends", "last", "spoken"])

    return df.select("id", "prompt", "reply").mapInArrow(run, "id bigint, prompt string, reply string, copy boolean, refusal boolean, other_language boolean, ends string, last string, spoken string")


def sentence_ends(df: DataFrame, text: str, spoken: str, asked: DataFrame, least: int = 2, share: float = 0.1) -> DataFrame:
    """(spoken, last): of the words asked about (last), by language, and with '' for all of them, those (or pairs of
    ideographs) that end a sentence in at least `share` of the part of their occurrences that words do on average [choice:
    unpunctuated ends are far oftener complete than cut], which does not depend on the size of the table; an end seen less
    than `least` times may be an accident. All texts are counted; only counts of words that are asked about are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, stops = defaultdict(Counter), Counter()
            for t, name in zip(*(c.to_pylist() for c in batch.columns)):
                seen[name].update(last_words(t))
                stops.update((name, w) for s in ENDED.findall(t) if (w := last_word(s)))
            rows = [(n, w, k, stops[n, w]) for n, own in seen.items() for w, k in own.items()]
            rows += [(n, None, sum(own.values()), sum(stops[n, w] for w in own)) for n, own in seen.items()]  # all words
            columns = list(zip(*rows)) or [[]] * 4
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["spoken", "last", "seen", "stops"])

    words_ = checked(asked.select("last").where("last is not null").distinct().withColumn("asked", F.lit(True)))
    rows = df.select(text, spoken).mapInArrow(run, "spoken string, last string, seen bigint, stops bigint").join(words_, "last", "left").where("asked or last is null")
    total = [F.sum(c).alias(c) for c in ("seen", "stops")]
    own = rows.groupBy("spoken", "last").agg(*total).checkpoint()
    counts = own.where("spoken <> ''").unionByName(own.withColumn("spoken", F.lit("")).groupBy("spoken", "last").agg(*total))
    mean = counts.where("last is null").select("spoken", (F.col("stops") / F.col("seen")).alias("mean"))  # a row per language
    return counts.where("last is not null").join(F.broadcast(mean), "spoken").where((F.col("stops") >= least) & (F.col("stops") >= share * F.col("mean") * F.col("seen"))).select("spoken", "last")


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over texts in order: the ids of those that a later whole text of this partition goes on from (HIT), those that a
    text of a later partition may go on from (OPEN, with their text), and the first whole texts (HEAD): of all, and of
    those that differ from the partition's first text. The texts that begin the current one are a stack."""
    stack: list[list] = []  # text, its ids
    part, first, heads = None, None, []

    def rows(kind: int, items: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(items), pa.int32()), pa.array([part] * len(items), pa.int32()), pa.array([t for t, _ in items], pa.string()), pa.array([i for _, i in items], pa.list_(pa.int64()))], names=["kind", "part", "text", "ids"])

    for batch in batches:
        hits = []
        for text, id_, whole, part in zip(*(c.to_pylist() for c in batch.columns)):
            first = text if first is None else first
            while stack and not text.startswith(stack[-1][0]):
                stack.pop()
            if stack and stack[-1][0] == text:
                stack[-1][1].append(id_)
            else:
                stack.append([text, [id_]])
            if whole:
                hits += [[None, ids] for t, ids in stack[:-1] if ids]
                stack = [[t, []] for t, _ in stack[:-1]] + stack[-1:]
                if not heads or len(heads) == 1 and heads[0] == first and text != first:
                    heads.append(text)
        if hits:
            yield rows(HIT, hits)
    if part is not None:
        yield rows(OPEN, [[t, ids] for t, ids in stack if ids])
        yield rows(HEAD, [[t, [k]] for k, t in enumerate(heads)])


HIT, OPEN, HEAD = range(3)


def shortened(df: DataFrame, key: str, text: str, whole: str | None = None) -> DataFrame:
    """Keys of texts that are a proper beginning of another text, or of one that is `whole`. The texts are sorted once,
    equal ones by key too, over as many tasks as there are partitions, and each task passes over its own once. A text
    that begins another one begins the next different text in the order, and one that begins a whole text begins the
    next whole one, so of the other tasks only their first whole texts are needed."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = F.col(whole) if whole else F.lit(True)
    rows = df.select(F.col(text).alias("text"), F.col(key).alias("id"), kept.alias("whole")).where("text is not null")
    in_order = rows.repartitionByRange(n, "text", "id").sortWithinPartitions("text", "id").withColumn("part", F.spark_partition_id())
    found = in_order.mapInArrow(_beginnings, "kind int, part int, text string, ids array<bigint>").checkpoint()
    # at most two rows a partition: the next whole text after each partition, and the next that differs from that
    w = Window.orderBy(F.desc("part"), F.desc(F.col("ids")[0]))
    heads = found.where(F.col("kind") == HEAD)
    after = heads.withColumn("before", F.lag("text").over(w)).withColumn("other", F.last(F.when(F.col("before") != F.col("text"), F.col("before")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    after = after.where(F.col("ids")[0] == 0).select("part", F.col("text").alias("next"), "other")
    parts = found.select("part").distinct().join(after, "part", "left")
    before = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.select("part", F.last(F.when(F.col("next").isNotNull(), F.struct("next", "other")), ignorenulls=True).over(before).alias("ahead"))
    late = found.where(F.col("kind") == OPEN).join(ahead, "part")
    following = F.when(F.col("ahead.next") != F.col("text"), F.col("ahead.next")).otherwise(F.col("ahead.other"))
    hits = found.where(F.col("kind") == HIT).select("ids").union(late.where(following.startswith(F.col("text"))).select("ids"))
    return hits.select(F.explode("ids").alias("id"))


def length_spikes(df: DataFrame, least: int = 8, times: float = 6.0, reach: int = 20) -> DataFrame:
    """Lengths at which far more open replies stop than at the lengths around: at least `least`, and `times` the mean
    within `reach`. One row per length goes through the window."""
    counts = df.groupBy(F.length("reply").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("length").rangeBetween(-reach, reach)
    around = (F.sum("n").over(w) - F.col("n")) / F.lit(2.0 * reach)
    return counts.withColumn("around", around).where((F.col("n") >= least) & (F.col("n") >= times * F.greatest("around", F.lit(0.5)))).select("length")


def defective_pairs(df: DataFrame, key: str, prompt: str, reply: str) -> DataFrame:
    """(key, defect) of every pair with a defect: 'empty', 'copy', 'refusal', 'language' or 'truncated', the first of
    these that fits. Pairs with a blank prompt are left aside, blank replies are empty; repeated rows come out as often;
    an empty table gives an empty result; other columns are ignored. Keys are integers; a null key stays null."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(prompt).alias("prompt"), F.col(reply).alias("reply")).where(~is_blank(F.col("prompt")))
    empty = rows.where(is_blank(F.col("reply"))).select("id", F.lit("empty").alias("defect"))
    judged = _features(rows.where(~is_blank(F.col("reply")))).withColumn("asked", F.md5(F.lower(F.trim("prompt")))).drop("prompt").checkpoint()
    early = F.when(F.col("copy"), "copy").when(F.col("refusal"), "refusal").when(F.col("other_language"), "language")
    rest = judged.where(early.isNull())
    flag = lambda df, name: checked(df.withColumn(name, F.lit(True)))
    unsure = rest.where("ends in ('short', 'item')")
    stops = flag(sentence_ends(judged, "reply", "spoken", unsure), "stops")
    cut = flag(shortened(judged.select("id", "reply"), "id", "reply").distinct(), "cut")
    # the same prompt has a complete answer that only goes on
    answers = rest.select("id", F.concat("asked", F.rtrim("reply")).alias("answer"), (F.col("ends") == "end").alias("whole"))
    begun = flag(shortened(answers, "id", "answer", "whole").distinct(), "begun")
    # a length limit: open replies crowd at a length, and so do those that stop there with a complete ending by chance
    limits = length_spikes(rest.where("ends = 'open'")).join(length_spikes(rest.where("ends <> 'open'").select("reply").distinct()), "length")
    doubtful = rest.where("ends <> 'open'").select("id", F.length("reply").alias("length"), "ends", "last", "spoken")
    doubtful = doubtful.join(stops, ["spoken", "last"], "left").join(cut, "id", "left").join(begun, "id", "left").join(flag(limits, "spike"), "length", "left")
    known_end = F.col("stops").isNotNull()
    broken = (
        F.when(F.col("begun") | F.col("spike"), True)
        .when(F.col("ends") == "end", False)
        .when(F.col("ends") == "short", ~known_end & (F.coalesce("cut", F.lit(False)) | (F.col("length") >= 12)))
        .otherwise(~known_end)
    )
    truncated = rest.where("ends = 'open'").select("id").unionByName(doubtful.where(broken).select("id")).withColumn("defect", F.lit("truncated"))
    found = judged.select("id", early.alias("defect")).where("defect is not null")
    return empty.unionByName(found).unionByName(truncated).withColumnRenamed("id", key)
