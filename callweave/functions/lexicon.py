"""Word lists and ordered patterns that the conversation functions take as a parameter.

``DEFAULT`` holds Russian and Kazakh lists; its keywords are in ``keywords.json`` beside this file, and
``read_lexicon`` takes other lists from a JSON file.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from importlib import resources

from pyspark.sql import SparkSession

# Fixed values of the domain: lists in their natural order, and ordered patterns.

#: Words that tell Russian.
RU_HINTS = [
    "здравствуйте", "добрый", "день", "вечер", "утро", "можно", "скажите", "пожалуйста", "спасибо", "да", "нет", "хорошо", "сейчас", "будет", "номер",
    "заявка", "договор", "оплата", "банк", "кредит", "карта", "счет", "счёт", "менеджер", "оператор", "клиент", "услуга", "подскажите",
]
#: Words that tell Kazakh.
KK_HINTS = [
    "сәлеметсіз", "сәлем", "қайырлы", "рахмет", "иә", "жоқ", "жақсы", "қазір", "өтінемін", "айтыңыз", "нөмір", "өтініш", "төлем", "шот", "несие",
    "қызмет", "күн", "кеш",
]
#: Phrases that say too little to be keywords of a call.
GENERIC = [
    "банк", "банка", "система", "номер", "телефон", "работает", "рабочее время", "сегодня", "завтра", "бүгін", "ертең", "қалай", "қайда", "қашан",
    "сұрақ", "қай жерден", "күндері", "жерден", "хабарласып", "можно", "нужно", "надо", "подскажите", "пожалуйста", "спасибо", "жақсы", "рахмет",
    "рақмет",
]
#: Keywords too weak to stand for a call.
WEAK = [
    "деньги", "ақша", "счет", "счёт", "шот", "карта", "карту", "карточка", "кредит", "несие", "код", "смс", "оплата", "платеж", "платёж", "төлем",
]
#: Keywords that tell a call's problem by themselves.
STRONG = [
    "не могу войти", "не могу зайти", "зайти не могу", "неверный логин", "неверный пароль", "восстановить пароль", "сбросить пароль", "заблокирован аккаунт",
    "логин ұмыттым", "пароль ұмыттым", "кіре алмай жатырмын", "аккаунтқа кіре алмай тұрмын",
    "не приходит смс", "не приходит код", "неправильный код подтверждения", "код просрочен", "приложение не открывается", "приложение вылетает", "қосымша ашылмайды", "смс келмей жатыр", "код келмеді",
    "превышен лимит", "превышен лимит по карте", "лимит на переводы", "карта заблокирована", "заблокировали карту", "разблокировать карту", "банкомат не выдал деньги", "банкомат зажевал карту",
    "лимит асып кетті", "карта бұғатталды", "банкомат ақша бермеді",
    "не могу отправить перевод", "перевод не уходит", "перевод завис", "не зачислились деньги", "не дошли деньги", "деньги не пришли", "платеж не прошел", "платёж не прошёл", "двойное списание", "списали дважды",
    "ақша түскен жоқ", "аударым өтпей жатыр", "төлем өтпеді",
    "досрочное погашение", "частичное досрочное", "не могу погасить кредит", "просроченная задолженность", "отсрочка платежа", "кредитные каникулы", "реструктуризация долга", "арест счета", "исполнительный лист", "удержания из зарплаты",
    "несие төлей алмаймын", "мерзімі өткен берешек", "төлем кестесі", "кредиттік демалыс",
    "звонили мошенники", "украли деньги", "несанкционированное списание", "не совершал эту операцию", "заблокируйте карту срочно", "алаяқтар хабарласты", "ақша ұрланды", "мен жасамаған операция",
    "отделение", "рабочее время", "суббота", "воскресенье", "бөлімше қайда", "жұмыс уақыты қандай", "сенбі күні ашық па",
]
#: Pieces of words that mark trouble.
MARKERS = ["не могу", "не получается", "не работает", "не проходит", "не приходит", "заблок", "превышен", "просроч", "досроч", "удержан", "списал", "завис", "ошибка", "ұстал", "өтпей", "келм", "түскен жоқ", "бұғат", "берешек", "төлей алмай"]
#: The keywords of problems, Russian and Kazakh, as a data file.
KEYWORDS = json.loads(resources.files(__package__).joinpath("keywords.json").read_text("utf-8"))
#: One name for variants of a keyword.
CANONICAL = {"счёт": "счет", "счет": "счет", "платёж": "платеж", "платеж": "платеж", "карточка": "карта", "карту": "карта", "карта": "карта", "кредитов": "кредит", "смс": "смс код", "код": "код", "ақша": "ақша", "шот": "шот", "төлем": "төлем", "несие": "несие"}
#: Words whose loss would change what a call is about.
CRITICAL = [
    "кредит", "кредита", "кредитов", "карта", "карту", "карточка", "лимит", "пароль", "логин", "код", "смс", "аккаунт", "перевод", "деньги", "счет",
    "счёт", "шот", "оплата", "платеж", "платёж", "просрочка", "отсрочка", "удержания", "списание", "списали", "пополнить", "пополнил",
    "задолженность", "долг", "комиссия", "банкомат", "отделение", "мошенники", "мошенничество", "заблокирована", "заблокировали", "разблокировать",
    "несие", "төлем", "төлей", "төледім", "төлеп", "ақша", "шот", "берешек", "қарыз", "аударым", "карта", "лимит", "код", "смс", "логин", "пароль",
    "құпия", "қосымша", "бұғатталды", "бұғаттау", "алаяқтар",
]
#: Words that are never important.
UNIMPORTANT = [
    "банк", "банка", "система", "номер", "телефон", "работает", "можно", "нужно", "надо", "есть", "будет", "сейчас", "сегодня", "завтра", "там",
    "тут", "это", "что", "как", "где", "когда", "уже", "просто", "тоже", "мен", "сіз", "біз", "ол", "бұл", "сол", "осы", "бойынша", "қалады", "болды",
    "болады", "керек", "дейін", "кейін", "қалай", "қайда", "қашан", "нөмірі", "нөмір", "жерден", "күндері", "бүгін", "ертең",
]
#: Turns that say nothing.
EMPTY_PHRASES = [
    "", "ну", "да", "нет", "ага", "угу", "мхм", "мм", "эм", "ээ", "эээ", "а", "о", "хорошо", "понятно", "ясно", "ладно", "ок", "окей", "спасибо",
    "спасибо большое", "благодарю", "до свидания", "досвидания", "всего доброго", "всего хорошего", "алло", "алло алло", "алё", "але", "меня слышно",
    "вы меня слышите", "слышно", "не слышно", "вас не слышно", "я вас не слышу", "меня не слышно", "плохо слышно", "повторите",
    "повторите пожалуйста", "что", "что что", "не понял", "не поняла", "я ошибся", "я ошиблась", "ошибся", "ошиблась", "ошибся номером",
    "ошиблась номером", "не туда попал", "не туда попала", "не туда позвонил", "не туда позвонила", "случайно набрал", "случайно набрала",
    "случайно позвонил", "случайно позвонила", "перезвоните позже", "позвоните позже", "я перезвоню", "перезвоню позже", "сейчас не могу говорить",
    "не могу говорить", "уже не актуально", "вопрос решен", "вопрос уже решен", "уже решил", "уже решила", "уже решили", "ничего не нужно",
    "ничего не надо", "не надо", "не нужно", "тишина", "гудки", "музыка", "шум", "неразборчиво", "автоответчик", "голосовая почта", "иә", "ия", "жоқ",
    "жаксы", "жақсы", "мақұл", "түсінікті", "рахмет", "рақмет", "көп рахмет", "сау болыңыз", "сау болыныз", "сау бол", "аман болыңыз", "аман болыныз",
    "жарайды", "болды", "естіп тұрсыз ба", "естіп тұрмын", "естімей тұрмын", "тыңдап тұрмын", "қайта айтыңыз", "қайталаңыз", "қайталай аласыз ба",
    "не дедіңіз", "не дейсіз", "қате нөмір", "қате тердім", "қате хабарластым", "басқа нөмір", "кейін хабарласыңыз", "кейін қоңырау шалыңыз",
    "өзім хабарласамын", "кейін хабарласамын", "қазір сөйлесе алмаймын", "сұрақ шешілді", "енді керек емес", "қажет емес", "ештеңе керек емес",
    "жете аламыз", "сауыты",
]
#: Words of numbers, dates and money.
NUMBER_WORDS = [
    "ноль", "нуль", "один", "одна", "одно", "два", "две", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять", "десять", "одиннадцать",
    "двенадцать", "тринадцать", "четырнадцать", "пятнадцать", "шестнадцать", "семнадцать", "восемнадцать", "девятнадцать", "двадцать", "тридцать",
    "сорок", "пятьдесят", "шестьдесят", "семьдесят", "восемьдесят", "девяносто", "сто", "двести", "триста", "четыреста", "пятьсот", "шестьсот",
    "семьсот", "восемьсот", "девятьсот", "тысяча", "тысячи", "тысяч", "миллион", "миллиона", "миллионов", "миллиард", "миллиарда", "миллиардов",
    "первое", "второе", "третье", "четвертое", "четвёртое", "пятое", "шестое", "седьмое", "восьмое", "девятое", "десятое", "одиннадцатое",
    "двенадцатое", "тринадцатое", "четырнадцатое", "пятнадцатое", "шестнадцатое", "семнадцатое", "восемнадцатое", "девятнадцатое", "двадцатое",
    "тридцатое", "число", "числа", "день", "дня", "дней", "неделя", "недели", "недель", "месяц", "месяца", "месяцев", "год", "года", "лет", "январь",
    "января", "февраль", "февраля", "март", "марта", "апрель", "апреля", "май", "мая", "июнь", "июня", "июль", "июля", "август", "августа",
    "сентябрь", "сентября", "октябрь", "октября", "ноябрь", "ноября", "декабрь", "декабря", "тенге", "тиын", "рубль", "рубля", "рублей", "копейка",
    "копейки", "копеек", "доллар", "долларов", "процент", "процента", "процентов", "нөл", "бір", "екі", "үш", "төрт", "бес", "алты", "жеті", "сегіз",
    "тоғыз", "он", "жиырма", "отыз", "қырық", "елу", "алпыс", "жетпіс", "сексен", "тоқсан", "жүз", "мың", "бірінші", "екінші", "үшінші", "төртінші",
    "бесінші", "алтыншы", "жетінші", "сегізінші", "тоғызыншы", "оныншы", "жиырмасыншы", "отызыншы", "күн", "күні", "күнге", "күндері", "күндерінде",
    "апта", "аптада", "аптаға", "ай", "айда", "айға", "жыл", "жылы", "жылға", "қаңтар", "ақпан", "наурыз", "сәуір", "мамыр", "маусым", "шілде",
    "тамыз", "қыркүйек", "қазан", "қараша", "желтоқсан", "теңге", "пайыз",
]
#: Words left out of the top terms of a report.
REPORT_STOPWORDS = [
    "это", "что", "как", "для", "или", "там", "тут", "уже", "еще", "ещё", "меня", "мне", "мой", "моя", "мои", "ваш", "ваша", "вам", "вас", "они",
    "она", "оно", "его", "ему", "нее", "ней", "нас", "нам", "есть", "нет", "да", "ну", "вот", "просто", "сейчас", "потом", "здравствуйте", "спасибо",
    "пожалуйста", "хорошо", "добрый", "банк", "банка", "клиент", "оператор", "девушка", "мен", "сіз", "біз", "бұл", "сол", "осы", "және", "үшін",
    "бар", "жоқ", "иә", "ия", "рахмет", "жақсы", "қазір", "кейін", "керек",
]
#: Notices of recording, in order.
RECORDING_NOTICES = [
    (r"\bуведомляем\s+о\s+записи\s+разговора\b", "recording_notice_ru"),
    (r"\b(?:этот|данный|ваш)?\s*разговор\s+(?:будет\s+)?записыва(?:е|и)тся\b", "recording_notice_ru"),
    (r"\bзвонок\s+(?:будет\s+)?записыва(?:е|и)тся\b", "recording_notice_ru"),
    (r"\bәңгіменің\s+жазылуы\s+туралы\s+ескертеміз\b", "recording_notice_kk"),
    (r"\bсөйлесудің\s+жазылуы\s+туралы\s+ескертеміз\b", "recording_notice_kk"),
    (r"\bқоңырау\s+жазылады\b", "recording_notice_kk"),
]
#: Noise of recognisers and advertising, in order.
MISHEARD = [
    (r"\bдоктор\s+быка\b", "asr_bank_name_noise"),
    (r"\bсэр\s+быка\b", "asr_bank_name_noise"),
    (r"\bщербак\s+банка\b", "asr_bank_name_noise"),
    (r"\bпрозрачный\s+старбак\s+в\s+ангаре\b", "asr_bank_name_noise"),
    (r"\bдэвидтен\b", "asr_noise"),
    (r"\bбербок\s+шоу\b", "asr_noise"),
    (r"\bгейминатор\b", "asr_noise"),
    (r"\bвидео\s+пробирка", "asr_video_check_noise"),
    (r"\bбанк\s+рыбака\b", "asr_bank_name_noise"),
    (r"\bбанка\s+рыбы\s*камня\b", "asr_bank_name_noise"),
    (r"\bбанкир\s+бык\b", "asr_bank_name_noise"),
    (r"\bбаггер\s+бы\b", "asr_noise"),
    (r"\bзеленскийге\b", "asr_noise"),
    (r"\bвключайте\s+бизнес\s+на\s+полную\b", "promo_noise"),
    (r"\bгорячее\s+предложение\b", "promo_noise"),
    (r"\bкомисси[яю]\s+берем\s+на\s+себя\b", "promo_noise"),
]
#: Greetings and phrases of operators, in order.
GREETINGS = [
    (r"\bздравствуйте\b", "greeting_ru"),
    (r"\bдобрый\s+(?:день|вечер|утро)\b", "greeting_ru"),
    (r"\bдевушка\s+здравствуйте\b", "greeting_ru"),
    (r"\bподскажите\s+пожалуйста\b", "polite_phrase_ru"),
    (r"\bдевушка\b", "address_word_ru"),
    (r"\bпожалуйста\b", "polite_phrase_ru"),
    (r"\bвот\b", "filler_word_ru"),
    (r"\bчем\s+могу\s+помочь\b", "operator_intro_ru"),
    (r"\bменя\s+зовут\s+[а-яёәғқңөұүһі]+\b", "operator_intro_ru"),
    (r"\bя\s+слушаю\b", "operator_intro_ru"),
    (r"\bслушаю\s+вас\b", "operator_intro_ru"),
    (r"\bсаламатсыз\s+ба\b", "greeting_kk"),
    (r"\bсәлеметсіз\s+бе\b", "greeting_kk"),
    (r"\bтыңдап\s+тұрмын\b", "operator_intro_kk"),
    (r"\bтыңдап\s+отырмын\b", "operator_intro_kk"),
    (r"\bқосымша\s+сұрақтарыңыз\s+бар\s+ма\b", "operator_closing_kk"),
]
#: Thanks and farewells, in order.
CLOSINGS = [
    (r"\bспасибо\s+большое\b", "closing_ru"),
    (r"\bспасибо\b", "closing_ru"),
    (r"\bвсего\s+доброго\b", "closing_ru"),
    (r"\bвсего\s+добра\b", "closing_ru"),
    (r"\bдо\s+свидания\b", "closing_ru"),
    (r"\bрахмет\b", "closing_kk"),
    (r"\bрақмет\b", "closing_kk"),
    (r"\bсау\s+болыңыз\b", "closing_kk"),
    (r"\bаман\s+болыңыз\b", "closing_kk"),
    (r"\bқоңырау\s+шалғаныңызға\s+рақмет\b", "closing_kk"),
]
#: Requests for personal data, to the end of the text, in order.
CHECKS = [
    (r"\bдавайте\s+проверим\b.*?(?:фамилия|имя|отчество|дата\s+рождения|кодовое\s+слово|иин).*$", "verification_tail_ru"),
    (r"\b(?:ваша|ваш)?\s*полная\s+фамилия\s+имя\s+отчество\b.*$", "full_name_request_ru"),
    (r"\bфамилия\s+имя\s+отчество\b.*$", "full_name_request_ru"),
    (r"\b(?:ваша|ваш)?\s*дата\s+рождения\b.*$", "birth_date_ru"),
    (r"\bкодовое\s+слово\b.*$", "code_word_ru"),
    (r"\bв\s+таком\s+случае\s+ваш\b.*$", "verification_tail_ru"),
    (r"\bтуған\s+(?:жылыңыз|жылым|жуыңыз|күніңіз)\b.*$", "birth_date_kk"),
    (r"\bқұпия\s+сөзіңіз\b.*$", "code_word_kk"),
    (r"\bкод\s+сөзіңіз\b.*$", "code_word_kk"),
]
STRIPPED = [*RECORDING_NOTICES, *MISHEARD, *GREETINGS, *CLOSINGS, *CHECKS]
#: What a recogniser makes of advertising and of the bank's name, in texts for semantic search.
NOISE = [
    r"\bбанк\s+рыбака\b",
    r"\bбанка\s+рыбы\s*камня\b",
    r"\bбанкир\s+бык\b",
    r"\bдоктор\s+быка\b",
    r"\bсэр\s+быка\b",
    r"\bбаггер\s+бы\b",
    r"\bзеленскийге\b",
    r"\bвключайте\s+бизнес\s+на\s+полную\b",
    r"\bгорячее\s+предложение\b",
    r"\bкомисси[яю]\s+берем\s+на\s+себя\b",
]


def plain(word: str) -> str:
    """A word of a list as normalised texts have it."""
    return word.lower().replace("ё", "е")


@dataclass(frozen=True)
class Lexicon:
    """What a language or domain brings: ordered (pattern, reason) pairs and lists of normalised words."""

    patterns: list[tuple[str, str]] = field(default_factory=lambda: list(STRIPPED))
    keywords: list[str] = field(default_factory=lambda: [*KEYWORDS["ru"], *KEYWORDS["kk"]])
    canonical: dict[str, str] = field(default_factory=lambda: dict(CANONICAL))
    strong: list[str] = field(default_factory=lambda: list(STRONG))
    weak: list[str] = field(default_factory=lambda: list(WEAK))
    generic: list[str] = field(default_factory=lambda: list(GENERIC))
    markers: list[str] = field(default_factory=lambda: list(MARKERS))
    noise: list[str] = field(default_factory=lambda: list(NOISE))
    critical: list[str] = field(default_factory=lambda: list(CRITICAL))
    unimportant: list[str] = field(default_factory=lambda: list(UNIMPORTANT))
    empty_phrases: list[str] = field(default_factory=lambda: list(EMPTY_PHRASES))
    number_words: list[str] = field(default_factory=lambda: list(NUMBER_WORDS))
    stopwords: list[str] = field(default_factory=lambda: list(REPORT_STOPWORDS))

    def important_words(self) -> list[str]:
        """Words whose loss would change what a call is about: the critical ones and single keywords of four letters or more."""
        idle = {plain(w) for w in [*self.unimportant, *self.empty_phrases, *self.number_words]}
        single = [k for k in map(plain, self.keywords) if " " not in k and len(k) >= 4 and k not in idle]
        return sorted({plain(w) for w in self.critical} - {plain(w) for w in self.unimportant} | set(single))


DEFAULT = Lexicon()


def read_lexicon(spark: SparkSession, path: str, base: Lexicon = DEFAULT) -> Lexicon:
    """``base`` with the fields that a JSON object at ``path`` holds."""
    text = spark.read.option("wholetext", True).text(path).first()[0]
    given = json.loads(text)
    if "patterns" in given:
        given["patterns"] = [tuple(x) for x in given["patterns"]]
    return replace(base, **given)
