"""Problem 4: defective prompt and response pairs, each with its defect.

Truncation: a pushdown parser goes over the answer; fences, code spans, brackets, quotations and emphasis open and close
on its stack, and what is open at the end was cut off; so was a table row without its last bar and prose without an end
mark. Repetition of the question: greedy string tiling, the share of either text that common tiles cover. Refusals: each
sentence, courtesies aside, is derived by a production of the refusal grammar and adds nothing. Language: scripts of the letters, and
within a script the naive Bayes model of :mod:`langid`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from sparkquarry.llm.frames import integer_columns, integers
from sparkquarry.llm.langid import Model, is_prose, letters_of, plain
from sparkquarry.sources import spread

# Titles of reference lists, names of an answer, and placeholders for no answer.
_TITLES = "references|sources|citations|bibliography|quellen|quellenangaben|literatur|références|sources citées|referencias|fuentes|referências|fontes|riferimenti|fonti|источники|ссылки|джерела|посилання|参考资料|参考文献|引用来源|来源|資料|参考資料|出典|참고 자료|참고문헌|출처"
_FOOTER = re.compile(rf"(?:^|\n)[ \t]*(?:#{{1,6}}[ \t]*|\*\*)?(?:{_TITLES})(?:\*\*)?[ \t]*[:：]?(?:\*\*)?[ \t]*(?=\n|\[\d|$)(?P<list>(?:[ \t]*\n|[ \t]*(?:[-*+][ \t]|\d+[.)][ \t]|\[).*(?:\n|$))*)\s*$", re.I)
_LABEL = re.compile(r"^\W*(?:(?:answer|response|reply|antwort|réponse|respuesta|resposta|risposta|ответ|відповідь|答案|回答|答|回复|답변|답)\s*[:：])+", re.I)
_PLACEHOLDER = re.compile(r"^\W*(?:n\s*/\s*a|n\.a\.|null|none|nil|nan|undefined|empty|no answer|todo|tbd|无|空|なし|없음)?\W*$", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|<!--.*?-->", re.S)
_HIDDEN = re.compile(r"[​-‏‪-‮⁠﻿­]")

# Courtesies around a refusal.
_COURTESY = re.compile(
    r"^\W*(?:hello|hi|dear user|thank you(?: for [^,.!]*)?|thanks(?: for [^,.!]*)?|sorry|i(?:'|’)?m sorry|i am sorry|i apologi[sz]e|unfortunately|please (?:contact|consult|ask|try|rephrase)[^.!;]*"
    r"|您好|你好|感谢(?:提问|您的提问|您的?咨询)?|谢谢|抱歉|很抱歉|对不起|请联系[^。]*|建议联系[^。]*|こんにちは|ご質問ありがとうございます|申し訳(?:ありません|ございません)が?|すみません|恐れ入りますが"
    r"|안녕하세요|질문 감사합니다|죄송합니다(?:만)?|죄송하지만|hallo|guten tag|danke(?: für [^,.!]*)?|vielen dank(?: für [^,.!]*)?|leider|entschuldigung|es tut mir leid|bonjour|merci(?: pour [^,.!]*| de [^,.!]*)?|désolée?|malheureusement"
    r"|hola|gracias(?: por [^,.!]*)?|lo siento|lamentablemente|olá|obrigad[oa](?: por [^,.!]*| pela [^,.!]*)?|desculpe|infelizmente|lamento|ciao|salve|buongiorno|grazie(?: per [^,.!]*)?|mi dispiace|purtroppo"
    r"|ขออภัย(?:ครับ|ค่ะ|ด้วย)*|ขอโทษ(?:ครับ|ค่ะ|ด้วย)*|สวัสดี(?:ครับ|ค่ะ)?|ขอบคุณ(?:สำหรับคำถาม|ที่ถาม)?(?:ครับ|ค่ะ)?|กรุณาติดต่อ[^.]*|नमस्ते|क्षमा करें|माफ़? ?कीजिए|माफ़ करें|खेद है(?: कि)?|मुझे खेद है(?: कि)?|दुर्भाग्य से|प्रश्न के लिए धन्यवाद|धन्यवाद|مرحبا|عذرا|عذراً|آسف|أعتذر|للأسف|مع الأسف|شكرا(?: على سؤالك)?|شكراً(?: على سؤالك)?|يرجى الاتصال[^.]*"
    r"|здравствуйте|спасибо(?: за [^,.!]*)?|к сожалению|извините|простите|вітаю|дякую(?: за [^,.!]*)?|на жаль|вибачте)[\s,;.!。！，、:：]*",
    re.I,
)
# The terminals of the refusal grammar by language. cannot: an ability or will denied; tell: what an answer does; ignorance: not knowing; none: no such thing; lore: what an answer is made of; absent: not there, in one phrase; beyond, against: outside of, contrary to; bounds: what an answerer keeps to; if: what makes a sentence a condition, so no refusal.
_TERMINALS = {
    "en": {
        "cannot": r"(?:can(?:no|'|’)t|cannot|can not|could not|couldn(?:'|’)t|unable to|not able to|not allowed to|won(?:'|’)t|will not|must not|not (?:going|permitted) to)",
        "tell": r"(?<!the )(?<!an )(?:answer|help|assist|provide|respond|discuss|comply|find|say|share|tell|give|explain)(?!\w)",
        "ignorance": r"(?:(?:do not|don(?:'|’)t) know|no idea|not sure|(?:do not|don(?:'|’)t) have)",
        "absent": r"(?:(?:does|do|did) not (?:contain|include|provide|mention|cover|have)|(?:is|was|are|were) not (?:mentioned|covered|found|included|available|described|answered|provided))(?!\w)",
        "none": r"(?:no|nothing|insufficient)(?!\w)", "lore": r"(?<!the )(?<!an )(?:information|answers?|data|details?|idea|results?|match|entry|entries|evidence|context|about|found|relevant)(?!\w)",
        "beyond": r"(?:outside|beyond|out of)(?!\w)", "against": r"(?:against|violates?|contrary to)(?!\w)",
        "bounds": r"(?:scope|allowed|able|knowledge|capabilit\w*|remit|guidelines?|polic\w+|rules?)(?!\w)", "if": r"(?:if|when|whenever|unless|until|in case)(?!\w)",
    },
    "de": {
        "cannot": r"(?:kann|können|konnte|darf|dürfen|vermag)(?!\w)(?=[^.!?]*(?<!\w)(?:nicht|keine?n?)(?!\w))", "tell": r"(?:beantworten|antworten|helfen|geben|nennen|sagen|machen|bereitstellen|unterstützen|diskutieren|finden)(?!\w)",
        "ignorance": r"(?:weiß (?:es |das |ich )*(?:leider )?nicht|nicht (?:bekannt|sicher))", "none": r"(?:keine?n?|nichts|nicht)(?!\w)",
        "lore": r"(?:angaben|informationen|antwort|daten|treffer|hinweise|dazu|darüber|enthalten|gefunden|erwähnt|beschrieben)(?!\w)",
        "beyond": r"außerhalb", "against": r"(?:widersprich\w*|gegen|verst\w+ß\w* gegen)(?!\w)", "bounds": r"(?:meine[rsn]?|des|richtlinien|rahmens?|bereichs?|möglichkeiten|regeln)(?!\w)", "if": r"(?:wenn|falls|sofern|sobald|solange)(?!\w)",
    },
    "fr": {
        "cannot": r"(?:ne (?:peux|puis|pouvons|peut|saurais|saurions)|n(?:'|’)(?:ai|est) pas (?:le droit|autorisée?|en mesure) (?:de|d(?:'|’)))", "tell": r"(?:répondre|aider|fournir|donner|dire|discuter|traiter|partager|trouver)(?!\w)",
        "ignorance": r"(?:(?:ne |n(?:'|’)en )?sais (?:pas|rien)|n(?:'|’)ai (?:pas|aucune))", "none": r"(?:aucune?|rien|ne|n(?:'|’)(?:a|ai|est|ont|y a) (?:pas|rien|aucune?))(?!\w)",
        "lore": r"(?:informations?|réponse|données?|résultats?|mention|trouvée?s?|contient|contiennent|figure|dispose|connais|pertinente?s?|suffisamment)(?!\w)",
        "beyond": r"hors(?!\w)", "against": r"(?:contraire|contre|enfreint)(?!\w)", "bounds": r"(?:mon|mes|cadre|champ|règles|directives|compétences?)(?!\w)", "if": r"(?:si|lorsque|quand|tant que|sauf)(?!\w)",
    },
    "es": {
        "cannot": r"no (?:puedo|podemos|puede|pude|es posible|se me permite|estoy autorizad[oa] a)(?!\w)", "tell": r"(?:responder|ayudar(?:te|le)?|proporcionar|dar|decir|contestar|ofrecer|compartir|facilitar)(?!\w)",
        "ignorance": r"no (?:lo )?(?:sé|sabemos|tengo|dispongo)(?!\w)", "none": r"(?:no (?:se encontr\w+|se ha encontrado|hay|figura|aparece|contienen?)|ninguna?|nada)(?!\w)",
        "lore": r"(?:información|respuesta|datos?|resultados?|relevante|base|documentos?|suficientes?|sobre|esto|eso|al respecto)(?!\w)",
        "beyond": r"fuera de(?!\w)", "against": r"(?:contra|en contra de|contrario)(?!\w)", "bounds": r"(?:mi|mis|alcance|ámbito|normas|reglas|políticas?|directrices)(?!\w)", "if": r"(?:si|cuando|hasta que|a menos que)(?!\w)",
    },
    "pt": {
        "cannot": r"não (?:posso|consigo|podemos|pode|é possível|tenho permissão para|estou autorizad[oa] a)(?!\w)", "tell": r"(?:responder|ajudar|fornecer|dar|dizer|informar|discutir|compartilhar|encontrar)(?!\w)",
        "ignorance": r"não (?:o )?(?:sei|sabemos|tenho|disponho)(?!\w)", "none": r"(?:não (?:foi encontrad\w|foram encontrad\w+|encontrei|há|consta|contém|existe)|nenhuma?|nada)(?!\w)",
        "lore": r"(?:informaç\w+|respostas?|dados?|resultados?|relevantes?|base|documentos?|suficientes?|sobre|isso|a respeito)(?!\w)",
        "beyond": r"fora d[oae]s?(?!\w)", "against": r"(?:contra|contrári[oa])(?!\w)", "bounds": r"(?:meu|minhas?|escopo|âmbito|normas|regras|políticas?|diretrizes)(?!\w)", "if": r"(?:se|quando|até que|a menos que|caso)(?!\w)",
    },
    "it": {
        "cannot": r"(?:non (?:posso|possiamo|può|sono in grado di|è possibile|mi è permesso)|impossibile)(?!\w)", "tell": r"(?:rispondere|aiutar\w+|fornire|dare|dire|trattare|condividere|trovare)(?!\w)",
        "ignorance": r"non (?:lo )?(?:so|sappiamo|ho|dispongo)(?!\w)", "none": r"(?:non (?:è stat\w|sono stat\w|ci sono|c(?:'|’)è|contiene|risulta\w*)|nessun[oa]?|niente|nulla)(?!\w)",
        "lore": r"(?:informazion\w+|rispost\w|dat[oi]|risultat[oi]|pertinent\w|rilevant\w|base|document\w+|sufficient\w|trovat\w|al riguardo|questo)(?!\w)",
        "beyond": r"fuori da\w*(?!\w)", "against": r"(?:contro|contrari[oa])(?!\w)", "bounds": r"(?:mi[oae]i?|ambito|regole|norme|politiche|competenze)(?!\w)", "if": r"(?:se|quando|finché|qualora)(?!\w)",
    },
    "ru": {
        "cannot": r"(?:не (?:могу|можем|может|имею права|в состоянии|вправе)|нельзя)(?!\w)", "tell": r"(?:ответить|отвечать|помочь|помогать|предоставить|дать|сказать|обсуждать|сообщить|найти)(?!\w)",
        "ignorance": r"не (?:знаю|знаем|располагаю|имею|удалось|уверен\w*)(?!\w)", "none": r"(?:не (?:найден\w*|содерж\w+|указан\w*|упомина\w+|нашл\w+)|нет|отсутств\w+|ничего)(?!\w)",
        "lore": r"(?:ответа?|информаци\w+|сведени\w+|данны\w+|результат\w*|подходящ\w+|достаточн\w+|базе|документ\w+|об этом)(?!\w)",
        "beyond": r"(?:вне|за рамк\w+|за предел\w+|выходит за)(?!\w)", "against": r"(?:против\w*|наруша\w+)(?!\w)", "bounds": r"(?:мо(?:ей|их|его|им)|рам\w+|предел\w+|правил\w*|полномочи\w*|компетенци\w*)(?!\w)", "if": r"(?:если|когда|пока|в случае)(?!\w)",
    },
    "uk": {
        "cannot": r"не (?:можу|можемо|може|маю права|в змозі)(?!\w)", "tell": r"(?:відповісти|відповідати|допомогти|надати|дати|сказати|обговорювати|повідомити|знайти)(?!\w)",
        "ignorance": r"не (?:знаю|знаємо|маю|вдалося|впевнен\w*)(?!\w)", "none": r"(?:не (?:знайден\w*|містит\w+|вказан\w*|згадано)|немає|відсутн\w+|нічого)(?!\w)",
        "lore": r"(?:відповід\w+|інформаці\w+|відомост\w+|дани\w+|результат\w*|відповідн\w+|достатн\w+|базі|документ\w+|про це)(?!\w)",
        "beyond": r"(?:поза|за меж\w+|виходить за)(?!\w)", "against": r"(?:проти\w*|порушу\w+)(?!\w)", "bounds": r"(?:мо(?:єї|їх|го|їми)|меж\w+|правил\w*|повноважен\w*|компетенці\w*)(?!\w)", "if": r"(?:якщо|коли|доки|у разі)(?!\w)",
    },
    "zh": {
        "cannot": r"(?:无法|不能|没法|不便|未能|不可以|难以|恕不)", "tell": r"(?:回答|作答|提供|协助|帮助|解答|答复|确定|找到|判断|给出|回应|讨论)", "ignorance": r"(?:不(?:太)?(?:清楚|知道|了解|确定)|没有答案)",
        "none": r"(?:没有|未|(?:找|查|搜)不到|缺乏|不足|不够)", "lore": r"(?:找到|提到|提及|相关|足够|信息|资料|答案|说明|涉及|记载|检索到|发现|查到|内容)", "beyond": r"(?:超出|不在|超越)", "against": r"(?:违反|违背|有悖)", "bounds": r"(?:范围|能力|权限|规定|准则|原则|政策)", "if": r"(?:如果|若|假如|一旦|除非)",
    },
    "ja": {
        "cannot": r"(?:でき(?:ません|ない|かね)|しかね|いたしかね|応じられ(?:ません|ない))", "tell": r"(?:お?答え|回答|お?手伝い|提供|ご?案内|お応え|対応|判断|ご?質問)", "ignorance": r"(?:(?:わか|分か)りません|(?:存じ|知り)(?:上げ)?ません|不明です)",
        "none": r"(?:見つかりません|見つかっていません|ありません|記載され(?:て(?:い|お)ら?)?(?:ません|ず)|含まれて(?:い|おり)?ません|不足|ございません)", "lore": r"(?:情報|記載|該当|資料|データ|回答|答え|内容)", "beyond": r"(?:範囲外|超えて|対象外)", "against": r"(?:違反|反し)", "bounds": r"(?:範囲|規定|方針|ガイドライン|権限|対象外)", "if": r"(?:もし|場合|とき|時は|たら、)",
    },
    "ko": {
        "cannot": r"수(?:가|는)?\s?없(?:습니다|어요|다|음)", "tell": r"(?:답변|대답|도움|도와|제공|안내|확인|알려|찾을|답할|논의)", "ignorance": r"(?:모르겠|모릅니다|알지 못|알 수 없)", "none": r"(?:찾(?:을 수 없|지 못)|없(?:습니다|어요|음)|부족|포함되어 있지 않|언급되지 않)",
        "lore": r"(?:정보|자료|답변|내용|문서|데이터|관련)", "beyond": r"(?:벗어|밖)", "against": r"(?:위배|위반|어긋)", "bounds": r"(?:범위|지침|규정|정책|권한)", "if": r"(?:만약|경우|때에|(?:으)?면\s)",
    },
    "th": {
        "cannot": r"(?:ไม่สามารถ|ไม่อาจ|ไม่ได้รับอนุญาต)", "tell": r"(?:ตอบ|ช่วย|ให้ข้อมูล|ให้คำ|บอก|อธิบาย|พูดคุย|ดำเนินการ)", "ignorance": r"(?:ไม่ทราบ|ไม่รู้|ไม่แน่ใจ)", "none": r"(?:ไม่พบ|ไม่มี|ไม่ได้ระบุ|ไม่ได้กล่าว|ไม่เพียงพอ)", "lore": r"(?:ข้อมูล|คำตอบ|เนื้อหา|รายละเอียด|เอกสาร|เกี่ยวข้อง|เกี่ยวกับ)",
        "beyond": r"(?:นอก|เกิน)", "against": r"(?:ขัดต่อ|ขัดกับ|ละเมิด|ผิด)", "bounds": r"(?:ขอบเขต|นโยบาย|แนวทาง|กฎ|ความสามารถ)", "if": r"(?:ถ้า|หาก|เมื่อ)",
    },
    "hi": {
        "cannot": r"(?:नहीं (?:कर |दे |बता |हो )?(?:सकता|सकती|सकते|सका|सकूँगा|पा रहा|पाया)|असमर्थ|अक्षम|अनुमति नहीं)", "tell": r"(?:उत्तर|जवाब|मदद|सहायता|बता|जानकारी|दे|चर्चा|प्रदान)", "ignorance": r"(?:नहीं (?:जानता|जानती|जानते|पता)|पता नहीं|मालूम नहीं|निश्चित नहीं)",
        "none": r"(?:नहीं (?:मिल\w*|मिली|मिला|है|हैं|दी गई|दिया गया)|कोई|अपर्याप्त|पर्याप्त नहीं|उल्लेख नहीं)", "lore": r"(?:जानकारी|उत्तर|जवाब|सूचना|विवरण|डेटा|संदर्भ|दस्तावेज़?|प्रासंगिक|उल्लेख)", "beyond": r"(?:बाहर|परे)", "against": r"(?:विरुद्ध|खिलाफ|ख़िलाफ़|उल्लंघन)", "bounds": r"(?:दायरे|सीमा|क्षेत्र|नियम\w*|दिशा-?निर्देश\w*|नीति\w*)", "if": r"(?:यदि|अगर|जब)",
    },
    "ar": {
        "cannot": r"(?:لا (?:أستطيع|استطيع|يمكنني|يمكننا|يمكن|نستطيع|أقدر)|لست قادرا?ً?|غير قادر|لن (?:أتمكن|أستطيع)|لا يسمح لي|غير مسموح)", "tell": r"(?:الإجابة|الاجابة|إجابة|الرد|المساعدة|مساعدت\w*|تقديم|توفير|أجيب|أساعد|إعطاء|مناقشة)", "ignorance": r"(?:لا (?:أعرف|اعرف|أعلم|اعلم|أدري|نعرف)|لست متأكدا?ً?)",
        "none": r"(?:لا (?:توجد|يوجد|تتوفر|تتوافر|يحتوي|تحتوي|يتضمن|تتضمن)|لم (?:أجد|يتم العثور|يُ?عثر|يرد|يُ?ذكر|أعثر)|ليس (?:لدي|هناك)|ليست (?:لدي|هناك)|غير كاف\w*)", "lore": r"(?:معلومات|إجابة|اجابة|بيانات|تفاصيل|نتائج|ذكر|صلة|السياق|المستندات|الوثائق|هذا|ذلك)",
        "beyond": r"(?:خارج|يتجاوز|تتجاوز)", "against": r"(?:ضد|يخالف|تخالف|مخالف\w*|ينتهك|يتعارض)", "bounds": r"(?:نطاق|إرشادات\w*|سياس\w+|قواعد\w*|صلاحي\w+|قدرات\w*)", "if": r"(?:إذا|اذا|عندما|لو)(?!\w)",
    },
}
#: The productions: a refusal is one of these, its symbols in any order, as languages differ, with no more than ``GAP`` words between.
_PRODUCTIONS = [("ignorance",), ("absent",), ("cannot", "tell"), ("none", "lore"), ("beyond", "bounds"), ("against", "bounds")]
GAP = 6
_BY_SCRIPT = {"latin": ["en", "de", "fr", "es", "pt", "it"], "cyrillic": ["ru", "uk"], "han": ["zh"], "kana": ["ja"], "hangul": ["ko"], "thai": ["th"], "devanagari": ["hi"], "arabic": ["ar"]}


def _bound(lang: str) -> str:
    return r"(?<!\w)" if lang in (*_BY_SCRIPT["latin"], *_BY_SCRIPT["cyrillic"], "hi", "ar") else ""


@cache
def _denials(script: str) -> re.Pattern:
    """What every production has one of, in any language of a script."""
    return re.compile("|".join(_bound(x) + _TERMINALS[x][k] for x in _BY_SCRIPT[script] for k in ("cannot", "ignorance", "absent", "none", "beyond", "against") if k in _TERMINALS[x]), re.I)


@cache
def _each_terminal(lang: str) -> dict[str, re.Pattern]:
    return {k: re.compile(_bound(lang) + v, re.I) for k, v in _TERMINALS[lang].items()}


def derives_refusal(sentence: str, lang: str) -> bool:
    """Whether some part of a sentence is derived by a production, and no condition stands before it."""
    # terminals may overlap (a word can be of two kinds), so each kind is looked for by itself
    places = {k: [m.span() for m in p.finditer(sentence)] for k, p in _each_terminal(lang).items()}
    condition = min((a for a, _ in places["if"]), default=len(sentence))
    spaced = lang not in ("zh", "ja", "th")
    for symbols in _PRODUCTIONS:
        if not all(x in places for x in symbols):
            continue
        if len(symbols) == 1:
            if any(a < condition for a, _ in places[symbols[0]]):
                return True
            continue
        for a, b in places[symbols[0]]:
            for c, d in places[symbols[1]]:
                if min(a, c) > condition:
                    continue
                between = sentence[b:c] if c >= b else sentence[d:a]
                if (len(between.split()) if spaced else len(between)) <= (GAP if spaced else 2 * GAP):
                    return True
    return False


def refuses(sentence: str) -> bool:
    """Whether a sentence is a refusal in some language of its script."""
    script = script_of(sentence)
    if script not in _BY_SCRIPT or not _denials(script).search(sentence):
        return False
    return any(derives_refusal(sentence, lang) for lang in _BY_SCRIPT[script])


#: Words that join content to a phrase of refusal.
_CONTENT = re.compile(r"[,;:，；：]\s*(?:but|however|yet|though|although|except|aber|jedoch|doch|mais|cependant|toutefois|pero|sin embargo|mas|porém|ma|però|tuttavia|но|однако|але|проте|不过|但是?|然而|可是|ただし|しかし|하지만|그러나)\b|(?:但是?|不过|然而|可是)|(?:ませんが|ないが|없지만|없으나)", re.I)
_SENTENCE = re.compile(r"[^.!?。！？।\n]+(?:[.!?。！？।]+|\n|$)")

_OPEN = dict(zip("([{（［｛【「『《〈«“„", ")]}）］｝】」』》〉»”“"))
_CLOSERS = set(_OPEN.values()) | {"”"}
#: What the pushdown parser stops at.
_SIGN = re.compile("[" + re.escape("".join(_OPEN) + "".join(sorted(_CLOSERS)) + "\\\"`*") + "]")
_END = re.compile(r"[.!?。！？؟।۔…][\"'”’»“)\]）】」』》*_`]*$")
_ITEM = re.compile(r"^\s*(?:[-*+•·‣]|\d{1,3}[.)、]|[(（]?\d{1,3}[)）]|[a-zA-Z][.)]|#{1,6})\s+\S")
#: The mark of an item with nothing behind it.
_BARE_MARK = re.compile(r"(?:[-*+•·‣]|\d{1,3}[.)、]|[(（]?\d{1,3}[)）]|[a-zA-Z][.)]|#{1,6})")
_FENCE = re.compile(r"^\s*(```+|~~~+)")


def without_footer(answer: str) -> str:
    """The answer without the list of references at its end."""
    m = _FOOTER.search(answer)
    return answer[: m.start()] if m else answer


def is_empty(answer: str | None) -> bool:
    """Nothing is said: no letters or digits but a label or a placeholder."""
    if answer is None:
        return True
    bare = _LABEL.sub("", _TAG.sub("", _HIDDEN.sub("", answer)).strip())
    return _PLACEHOLDER.match(bare) is not None


def tokens(text: str) -> list[str]:
    """Words, and single characters of scripts without spaces, in lower case."""
    return re.findall(r"[฀-๿぀-ヿ㐀-鿿]|[^\W_฀-๿぀-ヿ㐀-鿿]+", _HIDDEN.sub("", text).lower())


def tiled(a: list[str], b: list[str], shortest: int = 2) -> int:
    """Greedy string tiling: how many tokens of ``a`` the common tiles with ``b`` cover, the longest tiles first."""
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    places: dict[str, list[int]] = {}
    for j, t in enumerate(b):
        places.setdefault(t, []).append(j)
    while True:
        longest, matches = shortest, []
        for i in range(len(a)):
            if not free_a[i]:
                continue
            for j in places.get(a[i], ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and free_a[i + k] and free_b[j + k]:
                    k += 1
                if k > longest:
                    longest, matches = k, [(i, j)]
                elif k == longest:
                    matches.append((i, j))
        if not matches:
            return covered
        for i, j in matches:
            if all(free_a[i : i + longest]) and all(free_b[j : j + longest]):
                free_a[i : i + longest] = free_b[j : j + longest] = [False] * longest
                covered += longest


def is_copy(question: str | None, answer: str) -> bool:
    """The answer is the question again, however often, with no more than marks and labels around."""
    q, a = tokens(question or ""), tokens(_LABEL.sub("", answer))
    if not q or not a:
        return False
    if len(a) % len(q) == 0 and a[: len(q)] == q and a[len(q) :] == a[: -len(q)]:
        return True
    known = set(q)
    if sum(t in known for t in a) < 0.9 * len(a) - 1:  # no tiles can cover more
        return False
    spare = max(1, 0.1 * len(a))  # one token may be a label or number
    if len(a) < 1.5 * len(q):
        covered = tiled(a, q)
        return len(a) - covered <= spare and covered >= 0.8 * len(q)
    # each repetition by itself, from where the one before ends
    at = missed = 0
    while at < len(a) and missed <= spare:
        part = a[at : at + len(q)]
        if len(part) < 0.5 * len(q):  # an end cut short
            missed += len(part) - tiled(part, q, min(2, len(part)))
            break
        if part[0] != q[0] and q[0] in part[1:]:
            missed += (skip := part.index(q[0]))
            at += skip
            continue
        covered = tiled(part, q)
        if covered < 0.8 * len(q) and len(part) == len(q):
            return False
        missed += len(part) - covered
        at += len(part)
    return missed <= spare


def is_refusal(answer: str) -> bool:
    """Every sentence is a courtesy or derived as a refusal, and at least one is a refusal."""
    refused = False
    for m in _SENTENCE.finditer(_LABEL.sub("", answer)):
        s = m[0].strip(" \t\n\"'“”*_")
        while s and (c := _COURTESY.match(s)) and c.end():
            s = s[c.end() :]
        if not tokens(s):
            continue
        if _CONTENT.search(s) or not refuses(s):
            return False
        refused = True
    return refused


def open_at_end(text: str) -> tuple[list[str], bool]:
    """What the pushdown parser has open after the text, and whether the text ends with closed code."""
    stack: list[str] = []
    fence, closed_code = "", False
    for line in text.split("\n"):
        m = _FENCE.match(line)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence, closed_code = "", True
            continue
        if m and line.count(m[1][:3]) == 1:
            fence = m[1]
            continue
        if line.strip():
            closed_code = False
        else:
            stack.clear()  # a blank line ends a paragraph, and nothing inside goes on
            continue
        i, n = 0, len(line)
        if _ITEM.match(line):
            i = line.index(line.split()[0]) + len(line.split()[0])
        while i < n:
            if (m := _SIGN.search(line, i)) is None:
                break
            i = m.start()
            c = line[i]
            if stack and stack[-1] == "`":
                if c == "`":
                    stack.pop()
            elif c == "\\":
                i += 1
            elif c == "`":
                stack.append("`")
            elif line.startswith("**", i):
                stack.remove("**") if "**" in stack else stack.append("**")
                i += 1
            elif stack and c in (stack[-1], "”" if stack[-1] == "“" else stack[-1]) and c != '"':
                stack.pop()
            elif c == '"':
                if '"' in stack:
                    while stack.pop() != '"':
                        pass
                elif not (i and line[i - 1].isdigit()):
                    stack.append('"')
            elif c in _OPEN:
                stack.append(_OPEN[c])
            elif c in _CLOSERS and c in stack:
                while stack.pop() != c:
                    pass
            i += 1
    if fence:
        stack.append(fence)
    return stack, closed_code


#: Two words in a row; signs of commands and settings, which need no end mark.
_PLAIN, _CODE_SIGN = re.compile(r"[^\W\d_]{2,} [^\W\d_]{2,}"), re.compile(r"--|[=/|\\_`]")
_THAI = re.compile(r"[฀-๿]")


def is_truncated(answer: str) -> bool:
    """The answer breaks off: something is open, a table row lacks its end, an item has no more than its mark, or its last line is prose without an end mark."""
    text = answer.rstrip()
    stack, code = open_at_end(text)
    if stack:
        return True
    if code:
        return False
    lines = text.split("\n")
    last = lines[-1].strip()
    if last.startswith("|"):
        return not (last.endswith("|") and len(last) > 1)
    if len(lines) > 1 and _BARE_MARK.fullmatch(last):
        return True  # an item was begun
    if _ITEM.match(last) or _END.search(last):
        return False
    if re.search(r"[,;，；、（(]$", last):
        return True
    return (is_prose(last) or _PLAIN.search(last) is not None and _CODE_SIGN.search(last) is None) and len(_THAI.findall(last)) * 2 < len(last)


_SCRIPTS = [
    ("kana", re.compile(r"[぀-ヿ]")), ("hangul", re.compile(r"[가-힯]")), ("han", re.compile(r"[㐀-鿿]")), ("cyrillic", re.compile(r"[Ѐ-ԯ]")),
    ("thai", _THAI), ("devanagari", re.compile(r"[ऀ-ॿ]")), ("arabic", re.compile(r"[؀-ۿ]")), ("latin", re.compile(r"[A-Za-zÀ-ɏ]")),
]


def script_of(letters: str) -> str | None:
    """The script that most letters are of; kana in a tenth of Han and kana is Japanese."""
    if letters.isascii():
        return "latin" if _SCRIPTS[-1][1].search(letters) else None
    n = {name: len(p.findall(letters)) for name, p in _SCRIPTS}
    if n["kana"] * 10 >= n["kana"] + n["han"] and n["kana"]:
        n["kana"] += n["han"]
        n["han"] = 0
    for name in ("kana", "han", "hangul"):
        n[name] *= 3  # a character says what takes a few letters
    best = max(n, key=n.__getitem__)
    return best if n[best] else None


def spoken(text: str) -> str:
    """The letters of a text's prose lines."""
    return "".join(letters_of(x) for x in plain(text).split("\n") if is_prose(x) and not _FENCE.match(x))


#: How much likelier two languages must be than any one for both texts, in units of log likelihood.
MARGIN = 11.0


def defects(model: Model, questions: list[str | None], answers: list[str | None]) -> list[str | None]:
    """The defect of each pair, or None."""
    out: list[str | None] = []
    asked, said, at = [], [], []
    for i, (q, a) in enumerate(zip(questions, answers)):
        body = None if a is None else without_footer(a)
        if is_empty(body):
            out.append("empty_answer")
        elif is_refusal(body):
            out.append("refusal")
        elif is_copy(q, body):
            out.append("copied_question")
        elif is_truncated(body):
            out.append("truncated")
        else:
            out.append(None)
            asked.append(spoken(q or ""))
            said.append(spoken(body))
            at.append(i)
    if at:
        s_q, n_q = model.score(asked)
        s_a, n_a = model.score(said)
        for k, i in enumerate(at):
            a, b = script_of(asked[k]), script_of(said[k])
            if not a or not b or len(said[k]) < 6:
                continue
            if a != b:
                out[i] = "other_language"
            elif a != "han" and n_q[k] and n_a[k] and s_q[k].max() + s_a[k].max() - (s_q[k] + s_a[k]).max() > MARGIN:
                out[i] = "other_language"
    return out


def flag_pairs(df: DataFrame, model: Model, id_col: str = "result_id", question_col: str = "question", answer_col: str = "answer") -> DataFrame:
    """``id_col`` and ``defect`` of each distinct defective pair; null defects (sound pairs) are left out.

    A null answer is empty; a null question can be neither copied nor of another language. Pairs delivered again count
    once; of ids with several different pairs each defect counts once. Null ids are kept as one. Other columns are left out.
    """
    src = df.select(df[id_col], df[question_col].cast("string").alias("_q"), df[answer_col].cast("string").alias("_a"))
    src = spread(src, id_col)
    kind, whole = src.schema[0].dataType.simpleString(), integer_columns(src.schema[:1])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for part in (pdf.iloc[k : k + 1000] for k in range(0, len(pdf), 1000)):
                found = defects(shared.value, part["_q"].tolist(), part["_a"].tolist())
                keep = np.array([d is not None for d in found], bool)
                yield integers(pd.DataFrame({id_col: part[id_col][keep].reset_index(drop=True), "defect": pd.Series([d for d in found if d], dtype=object)}), *whole)

    return src.mapInPandas(run, f"`{id_col}` {kind}, defect string").distinct()
