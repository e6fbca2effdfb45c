"""Patterns of the text operators, as Java regular expressions.

(?U) makes \\w, \\s, \\b and \\d follow Unicode, (?i) with it ignores case."""

I, U = "(?iU)", "(?U)"

# Fixed values from here on: what counts as a match decides results.

CN_NUM = "0-9０-９一二三四五六七八九十百零〇两"
CHAPTER = U + rf"^第\s*[{CN_NUM}]+\s*[章篇部讲]"
SECTION = U + rf"^第\s*[{CN_NUM}]+\s*[节]"
DOTTED = U + r"^(\d{1,2}(?:\.\d{1,2})+)(?=[\s、.．:_：]|$)"
#: A dotted number as far as it goes, where it could end: of 28.68.191 the first five, and the 19 that starts the third.
DOTTED_LONGEST = U + r"^(?=\d{1,2}(?:\.\d{1,2})+(?:[\s、.．:_：]|$))(\d{1,2}(?:\.\d{1,2})+)"
SUB_CN = U + r"^[一二三四五六七八九十]{1,3}\s*、"
PAREN_CN = r"^（[一二三四五六七八九十]{1,3}）"
ARABIC_LIST = U + r"^\d{1,2}\s*[、.．]\s*\S"
ENGLISH_CHAPTER = I + r"^Chapter\s+\d+"
TOC_TAIL = U + r"(?:[.·…．]{2,}|[-–—]{1,2})\s*\d{1,4}\s*$"
TRAILING_DIGITS = U + r"\s*\d{1,4}\s*$"
PAGE_NUMBER = I + r"^[\s\-—–·.。]*(?:第\s*[0-9０-９]+\s*页|[0-9０-９]{1,4}|[IVXLCDM]{1,6}|Page\s*[0-9]{1,4})[\s\-—–·.。]*$"
SENTENCE_END = r"[。！？；…!?;”』」）)]$"
CJK_JOIN = r"[一-鿿　-〿＀-￯…—]"
DOTTED_PREFIX = U + r"^(\d{1,2})\.\d"
JIE_PREFIX = U + rf"^第\s*([{CN_NUM}]+)\s*节"
CJK_SENTENCE = r"(?<=[。！？；!?;])"
SENTENCE = U + r"(?<=[.!?])\s+"

LABEL_PREFIX = r"(Extended\s+Data|Supplementary|Suppl\.?)"
FIGURE_LABEL = r"(?:Figures|Figure|Figs\.|Fig\.|Figs|Fig)"
TABLE_LABEL = r"(?:Tables|Table)"
PANEL = r"([A-Za-z])?(?![A-Za-z0-9])"
LIST_TAIL = r"(?:(?:\s*(?:and|,|to|[-–]))\s*(\d+)(?![0-9]))?"
FIGURE_MENTION = I + rf"\b{LABEL_PREFIX}?\s*{FIGURE_LABEL}\s*(\d+)\s*{PANEL}{LIST_TAIL}"
TABLE_MENTION = I + rf"\b{LABEL_PREFIX}?\s*{TABLE_LABEL}\s*(\d+)\s*{PANEL}{LIST_TAIL}"
ANY_LABEL = r"(?:Figures|Figure|Figs\.|Fig\.|Tables|Table)"
CAPTION_START = I + rf"^(?:{LABEL_PREFIX}\s+)?{ANY_LABEL}\s*(\d+)\s*([A-Za-z])?\s*[.:：|—–]\s*"
INLINE_CAPTION = I + rf"(?:{LABEL_PREFIX}\s+)?{ANY_LABEL}\s*(\d+)\s*([A-Za-z])?\s*\|"
TABLE_START = I + rf"^(?:{LABEL_PREFIX}\s+)?Tables?\b"
PANEL_BOUNDARY = U + r"(?<![A-Za-z])([A-Ha-h])\s*,\s+(?=[A-Z(\d])"

INCREASE = I + r"\b(increas\w*|elevat\w*|up-?regulat\w*|promot(?:e|es|ed|ing)\b|enhanc(?:e|es|ed|ing|ement)\b|induc(?:e|es|ed|ing)\b|stimulat\w*|higher|rose|elevated|greater)\b"
DECREASE = I + r"\b(decreas\w*|reduc\w*|down-?regulat\w*|inhibit(?:s|ed|ing)\b|suppress(?:es|ed|ing|ion)\b|attenuat\w*|diminish\w*|lower\w*|less|fewer|drop(?:ped)?)\b"
NO_CHANGE = I + r"\b(no significant (?:difference|change|alteration)|not significantly (?:different|changed|altered)|unchanged|unaffected|comparable to|similar to)\b"
SIGNIFICANT = I + r"\bsignifican\w*\b"
NOT_SIGNIFICANT = I + r"\b(?:not|no|without)\s+significan\w*\b|\bnot\s+significant\b|\bns\b(?![a-z])"
P_VALUE = I + r"\bp\s*(?:<|>|=|≤|≥)\s*[\d.]+"
CORRELATION = I + r"\bcorrelat\w*(?:\s+(?:positively|negatively|strongly|weakly|significantly))?\s+with\b"
ASSOCIATION = I + r"\bassociat\w*(?:\s+(?:positively|negatively|strongly|significantly))?\s+with\b"
CAUSAL = I + r"\b(?:caus\w+|due to|result(?:ed|s|ing)? in|led to|leads to|driv\w+|mediat\w+|necessar\w+ for|sufficient for|because of)\b"
COMPARISON = I + r"\bcompared\s+(?:with|to|against)\b|\bvs\.?\b|\brelative to\b|\bin\s+response\s+to\b"
INHIBITION = I + r"\binhibit\w+|suppress\w+|block\w+|attenuat\w+"
ACTIVATION = I + r"\bactivat\w+|stimulat\w+|potentiat\w+\b"
KNOCKOUT = I + r"\bknock-?out\w*|\bknocked-?out\b|\bko\b(?![a-z])|\bsiRNA\b|\bshRNA\b|\bCRISPR\w*\b"
OVEREXPRESSION = I + r"\bover-?express\w*\b|\boverexpression\b"
DOSE_RESPONSE = I + r"\bdose-?dependent\b|\bdose\s+response\b|\bdoes-?response\b"
TIME_DEPENDENT = I + r"\btime-?(?:dependent|course|point)\b|\bover time\b|\bhours?\s+(?:after|post)\b|\bdays?\s+(?:after|post)\b"

CONTROL_TERM = I + r"\b(?:control(?:\s+group)?|untreated|untransfected|unstimulated|wild-?type|wt|vehicle|mock|sham|placebo|scrambled)\b"
TREATMENT_SPAN = (
    U + r"\b[Tt]reatment\s+[A-Z][\w-]*"
    r"|\b[A-Za-z][\w-]*(?:\s+[A-Za-z][\w-]*){0,2}-treated\b"
    r"|\b[Tt]reated\s+with\s+(?:the\s+|a\s+|an\s+)?[A-Za-z][\w-]*(?:\s+[A-Za-z][\w-]*)?"
)
GROUP_SPLIT = I + r"\b(?:divided|assigned|randomized|grouped)\s+into\s+(.{3,120}?)\s+groups?\b"
TREATED_WITH = U + r"^[Tt]reated\s+with\s+(?:the\s+|a\s+|an\s+)?"
ENTITY_BLOCK = (
    "significantly|increased|decreased|showed|shown|was|were|is|are|treated|compared|"
    "higher|lower|reduced|elevated|relative|respectively|of|for|in|on|at|to|with|by|from|"
    "and|or|the|a|an|between|after|following|during|when|while|that|which|"
    "promotes|promoted|enhances|enhanced|induces|induced|stimulates|stimulated|"
    "inhibits|inhibited|suppresses|suppressed|reduces|elevates|activates|activated"
)
ENTITY = rf"(?:(?!{ENTITY_BLOCK})[A-Za-z][\w/-]*(?:\s+(?!{ENTITY_BLOCK})[A-Za-z][\w/-]*){{0,2}}?)"
MEASURED_OF = (
    I + r"\b(expression|activity|abundance|concentration|levels?|rate|intensity|phosphorylation|secretion|production|weights?|up-?regulation|down-?regulation)\s+of\s+"
    rf"({ENTITY})" + r"(?=\s*(?:was|were|is|are|in|compared|than|between|after|following|[,.;:]|\(|$))"
)
MEASURED_SUFFIX = I + rf"\b({ENTITY})\s+(expression|activity|abundance|concentration|intensity|phosphorylation|secretion|production|weight|up-?regulation|down-?regulation)\b"
STATS_NOTE = I + r"^(?:Data\s+(?:were|are)|Statistics\s+(?:were|are)|\*{1,4}\s*P\b|NS\s*[,;.]|\(?\*{1,4}\)|P\s*[<=>])"
SUBJECT = I + r"\b(?:cells?|mice|rats?|patients?|subjects?|samples?|tissues?|plants?|seedlings?|flies?|fish|human\s+\w+|animals?)\b"
CONTENT_WORD = r"[A-Za-z][A-Za-z-]{2,}"
CONTENT_STOPWORDS = """the a an and or of in on at to for with by from as is are was were be been being this that these those
    we our it its their his her not no than then more most such can could may might will would should shall
    have has had do does did using used use show showed shown shows figure table fig results result method
    methods respectively however therefore thus whereas while when where which who whom whose what also both
    each between during after before above below over under into out up down about through during""".split()

PERCENTAGE = U + r"\b\d+(?:\.\d+)?\s*%"
FOLD_CHANGE = I + r"\b\d+(?:\.\d+)?\s*[-–]?\s*fold"
CONCENTRATION = U + r"\b\d+(?:\.\d+)?\s*(?:µ|μ|u|n|m|p)?(?:M|g(?:/m[lL])?|mol/L)\b"
TIME = I + r"\b\d+(?:\.\d+)?\s*(?:min(?:ute)?s?|h(?:ou?r)?s?|d(?:ay)?s?|weeks?|months?)\b"
NUMERIC_KINDS = [("percentage", PERCENTAGE), ("fold_change", FOLD_CHANGE), ("p_value", P_VALUE), ("concentration", CONCENTRATION), ("time", TIME)]
PANEL_GLUE = r"^[0-9]{1,3}[a-hA-H]$"
FIGURE_CONTEXT = I + r"fig(?:ure|\.)\s*$"

SECTION_KEYWORDS = [
    ("abstract", "abstract"), ("overview", "abstract"), ("introduction", "introduction"), ("background", "introduction"),
    ("materials and methods", "methods"), ("materials & methods", "methods"), ("methods and materials", "methods"), ("material and methods", "methods"),
    ("experimental procedures", "methods"), ("experimental section", "methods"), ("patients and methods", "methods"), ("study design", "methods"),
    ("method", "methods"), ("material", "methods"), ("results and discussion", "results"), ("result", "results"), ("discussion", "discussion"), ("conclusion", "discussion"),
]

DIRECTION_WORDS = {"increases": "decreases", "decreases": "increases", "increased": "decreased", "decreased": "increased", "increase": "decrease", "decrease": "increase", "higher": "lower", "lower": "higher"}
SIGNIFICANT_TRUE = U + r"^(.+?)\s+significantly\s+(increases|decreases)\s+(.+)$"
NEGATIONS = [
    ("would increase", "would not increase"), ("would decrease", "would not decrease"), ("is associated with", "is not associated with"), ("increases", "does not increase"),
    ("decreases", "does not decrease"), ("provides the baseline", "does not provide the baseline"), ("receives", "does not receive"), ("measures", "does not measure"),
]
KIND_LABELS = {"percentage": "percentage", "fold_change": "fold change", "p_value": "p value", "concentration": "concentration", "time": "time"}
DANGLING_FIGURE = U + r"\s*\((?:Extended Data |Supplementary )?Fig(?:ure)?\.?\s*[\w,\s–-]*$"
TRAILING_FIGURE = U + r"\s*\((?:Extended Data |Supplementary )?Fig(?:ure)?\.?\s*[\w,\s–-]*\)\s*$"
PANEL_LABEL_VALUE = U + r"^\d+[a-h]$"

TERMS = {
    "increases": "提高", "increase": "提高", "increased": "提高", "decreases": "降低", "decrease": "降低", "decreased": "降低",
    "upregulation": "上调", "downregulation": "下调", "upregulated": "上调", "downregulated": "下调",
    "control": "对照", "untreated": "未处理", "unstimulated": "未刺激", "wild-type": "野生型", "wild type": "野生型", "treatment": "处理", "treated": "处理",
    "inhibitor": "抑制剂", "knockout": "敲除", "knockdown": "敲低", "overexpression": "过表达", "group": "组", "baseline": "基线",
    "body weight": "体重", "migration distance": "迁移距离", "expression": "表达", "intensity": "强度", "migration": "迁移", "distance": "距离", "speed": "速度",
    "cells": "细胞", "weight": "重量", "level": "水平", "activity": "活性", "concentration": "浓度", "geometric mean": "几何平均",
}
DROPPED_WORDS = ["the", "a", "an", "of"]
KIND_ZH = {"percentage": "百分比", "fold change": "倍数变化", "p value": "p 值", "concentration": "浓度", "time": "时间"}

FIGURE_ANCHOR = I + r"(?:Extended Data |Supplementary )?(?:Figure|Table) \d+[a-h]?"
PRESERVED_TOKEN = U + r"\b(?:[A-Za-z]+\d[A-Za-z0-9]*|[A-Z]{2,})\b"
ZH_UP = ["提高", "增加", "升高", "增强", "上调", "增多"]
ZH_DOWN = ["降低", "减少", "下降", "减弱", "下调", "较低"]
EN_UP = I + r"\b(?:increases?|increased|higher)\b"
EN_DOWN = I + r"\b(?:decreases?|decreased|lower)\b"

QUERY_STOPWORDS = [
    "什么", "哪些", "哪里", "哪儿", "为何", "为什么", "如何", "怎么", "怎样", "怎么样", "多少", "是否", "几", "何",
    "的", "了", "是", "在", "和", "与", "及", "或", "对", "对于", "由", "从", "被", "把", "着", "过", "也", "都", "就", "会",
    "能", "可", "可以", "其", "该", "各", "每个", "么", "呢", "吗", "吧", "有", "无", "一个", "一种", "一样", "中", "等", "以及",
    "并且", "而且", "但是", "因此", "所以", "如果", "虽然", "关于", "请问", "请", "告诉我", "说说", "讲讲", "介绍", "进行", "使得", "属于", "成为",
]
SYNONYMS = {
    "氧气": ["o2", "氧"], "o2": ["氧气", "氧"], "二氧化碳": ["co2"], "co2": ["二氧化碳"], "血红蛋白": ["hb"], "hb": ["血红蛋白"],
    "三磷酸腺苷": ["atp"], "atp": ["三磷酸腺苷"], "血管紧张素": ["angiotensin"], "心电图": ["ecg", "ekg"],
}
