"""Text pattern rules: what to look for, as data."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class PatternRule:
    key: str
    regexes: tuple[str, ...]
    category: str = "basic"
    ignore_case: bool = False
    # "whole": value is the full hit; "group": value is group 1;
    # "tuple": value is the non-empty groups joined by a space.
    value: str = "whole"
    groups: int = 0
    # One of these must occur in the case-folded text for the rule to match at
    # all, and (digit) so must some digit.  Cheap tests that spare the regex.
    needs: tuple[str, ...] = ()
    digit: bool = False

    def java(self) -> list[str]:
        flags = "(?iU)" if self.ignore_case else "(?U)"
        return [flags + r for r in self.regexes]


# Currency words and the calendar words of the date rules.
CURRENCIES = "mlc|mn|usd|clásica|clasica|dólares|dolares|pesos|eur|euros|cup|clp|mxn|moneda nacional|dinero cubano"
MONTHS = "enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|octubre|noviembre|diciembre"
NUMBER = r"\d+(?:[.,]\d+)?"

# Basic patterns.
BASIC = [
    PatternRule("emails", (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",), "contact", True, needs=("@",)),
    PatternRule("phone_numbers", (r"(\+?\d{1,3}[-.\s]?)?\(?\d{2,4}\)?[-.\s]?\d{2,4}[-.\s]?\d{2,4}[-.\s]?\d{2,4}",), "contact", groups=1, digit=True),
    PatternRule("hashtags", (r"#\w+",), "social", needs=("#",)),
    PatternRule("mentions", (r"@\w+",), "social", needs=("@",)),
    PatternRule("urls_raw", (r"https?://[^\s]+",), "social", needs=("://",)),
    PatternRule("emojis", (r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]",), "social"),
    PatternRule("coordinates", (r"\b-?\d{1,3}\.\d+,\s*-?\d{1,3}\.\d+\b",), "technical", needs=(",",), digit=True),
    PatternRule("ip_addresses", (r"\b(?:\d{1,3}\.){3}\d{1,3}\b",), "technical", needs=(".",), digit=True),
    PatternRule("crypto_addresses", (r"\b[13][a-km-zA-HJ-NP-Z1-9]{25,34}\b|\b0x[a-fA-F0-9]{40}\b",), digit=True),
    PatternRule("credit_cards", (r"\b(?:\d{4}[- ]?){3}\d{4}\b",), digit=True),
    PatternRule("isbn_codes", (
        r"\b(?:ISBN(?:-1[03])?:? )?(?=[0-9X]{10}$|(?=(?:[0-9]+[- ]){3})[- 0-9X]{13}$|97[89][0-9]{10}$"
        r"|(?=(?:[0-9]+[- ]){4})[- 0-9]{17}$)(?:97[89][- ]?)?[0-9]{1,5}[- ]?[0-9]+[- ]?[0-9]+[- ]?[0-9X]\b",), digit=True),
    PatternRule("vehicle_plates", (r"\b[A-Z]{1,3}\s?-?\s?\d{1,4}\s?[A-Z]{0,2}\b",), digit=True),
    PatternRule("measurements", (r"\b\d+(?:\.\d+)?\s*(?:kg|g|mg|lb|oz|m|cm|mm|km|ft|in|L|ml|gal|m²|m2|cm²|cm2)\b",), "technical", True, digit=True),
    PatternRule("percentages", (r"\b\d+(?:\.\d+)?%(?!\w)",), needs=("%",)),
    PatternRule("mathematical_operations", (r"\b\d+\s*[\+\-\*\/]\s*\d+\s*=\s*\d+\b",), needs=("=",)),
    PatternRule("all_caps_words", (r"\b[A-Z]{3,}\b",)),
    PatternRule("repeated_letters", (r"\b\w*(\w)\1{2,}\w*\b",), value="group", groups=1),
    PatternRule("quoted_text", (r'["“”]([^"“”]+)["“”]',), value="group", groups=1, needs=('"', '“', '”')),
    PatternRule("parenthetical_text", (r"\(([^)]+)\)",), value="group", groups=1, needs=("(",)),
]

# Monetary patterns.  The first one has four branches, tried in
# order at each position: range, spelled range, amount "en" currency, amount currency.
EXPLICIT_MONEY = (
    rf"(\b\d+(?:\s*-\s*\d+)+)\s*({CURRENCIES})\b"
    rf"|\b(?:de|entre)\s+(\d+)\s*(?:a|y)\s+(\d+)\s*({CURRENCIES})\b"
    rf"|(\b\d+(?:[.,]?\d+)?)\s+en\s+({CURRENCIES})\b"
    rf"|(\b\d+(?:[.,]?\d+)?)\s+({CURRENCIES})\b"
)
MONETARY = [
    PatternRule("monedas_explicitas", (EXPLICIT_MONEY,), "financial", True, "tuple", 9, digit=True),
    PatternRule("precios_implicitos", (rf"\b(?:sale\s+en|son|cuesta|vale|esta\s+en|está\s+en)\s+({NUMBER})",), "financial", True, "group", 1, needs=("sale", "son", "cuesta", "vale", "est"), digit=True),
    PatternRule("currency_with_symbols", (rf"(?:\$|€|¥|£)\s*({NUMBER})\s+({CURRENCIES})\b",), "money", True, "tuple", 2, needs=("$", "€", "¥", "£"), digit=True),
    PatternRule("currency_decimal", (rf"\b({NUMBER})\s+({CURRENCIES})\b",), "money", True, "tuple", 2, digit=True),
    PatternRule("price_changes", (rf"\b(subió|subio|bajó|bajo)\s+(?:a\s+)?({NUMBER})",), "money", True, "group", 2, needs=("subi", "baj"), digit=True),
    PatternRule("labeled_prices", (rf"\b(?:precio|valor|costo|costó)\s*:?\s*({NUMBER})",), "money", True, "group", 1, needs=("precio", "valor", "cost"), digit=True),
    PatternRule("preposition_prices", (rf"\b(?:por|a|desde|hasta)\s+({NUMBER})",), "money", True, "group", 1, digit=True),
    PatternRule("discounts_percent", (r"(\d+)%\s*(?:off|de\s+descuento|descuento)",), "money", True, "group", 1, needs=("%",)),
    PatternRule("discounts_absolute", (rf"\brebajado\s+(?:a\s+)?({NUMBER})",), "money", True, "group", 1, needs=("rebajado",), digit=True),
]
# Branches of the explicit-money rule kept under their own keys as well.
MONEY_BRANCHES = ["currency_ranges", "currency_ranges_extended", "currency_in_format", "currency_without_en"]

# Date patterns (Spanish calendar expressions).
DATES = [
    PatternRule("dates_absolute", (r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b",), "temporal", True, needs=("/", "-"), digit=True),
    PatternRule("dates_spanish_format", (rf"\b\d{{1,2}}\s+de\s+({MONTHS})\s+de?\s+\d{{2,4}}\b",), "temporal", True, groups=1, needs=tuple(MONTHS.split("|")), digit=True),
    PatternRule("dates_month_first", (rf"\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b",), "temporal", True, needs=tuple(MONTHS.split("|")), digit=True),
    PatternRule("dates_relative_simple", (r"\b(hoy|ayer|antier|anteayer|mañana|pasado|pasado\s+mañana)\b",), "temporal", True, "group", 1, needs=("hoy", "ayer", "antier", "mañana", "pasado")),
    PatternRule("dates_relative_quantified", (r"\b(en|hace)\s+(\d+)\s+(dias|días|dia|día|semanas|semana|meses|mes|años|año)\b",), "temporal", True, "tuple", 3, needs=("dia", "día", "semana", "mes", "año"), digit=True),
    PatternRule("dates_weeks", (r"\b(semana\s+que\s+viene|semana\s+pasada|esta\s+semana|semana\s+anterior|semana\s+pr[oó]xima|pr[oó]xima\s+semana)\b",), "temporal", True, "group", 1, needs=("semana",)),
    PatternRule("dates_weekends", (r"\b(este\s+fin\s+de\s+semana|este\s+finde|finde\s+que\s+viene|fin\s+de\s+semana\s+que\s+viene|pr[oó]ximo\s+finde)\b",), "temporal", True, "group", 1, needs=("fin",)),
    PatternRule("dates_months", (r"\b(este\s+mes|mes\s+que\s+viene|mes\s+pr[oó]ximo|mes\s+pasado|pr[oó]ximo\s+mes|el\s+mes\s+que\s+viene)\b",), "temporal", True, "group", 1, needs=("mes",)),
    PatternRule("dates_years", (r"\b(este\s+año|año\s+que\s+viene|pr[oó]ximo\s+año|año\s+pasado|el\s+año\s+pasado|el\s+año\s+que\s+viene)\b",), "temporal", True, "group", 1, needs=("año",)),
    PatternRule("dates_months_specific", (rf"\b(en\s+)?({MONTHS})\b",), "temporal", True, "tuple", 2, needs=tuple(MONTHS.split("|"))),
    PatternRule("dates_weekdays", (r"\b(lunes|martes|miércoles|miercoles|jueves|viernes|sábado|sabado|domingo)\b",), "temporal", True, "group", 1, needs=("lunes", "martes", "miércoles", "miercoles", "jueves", "viernes", "sábado", "sabado", "domingo")),
    PatternRule("dates_seasons", (r"\b(primavera|verano|otoño|invierno)\b",), "temporal", True, "group", 1, needs=("primavera", "verano", "otoño", "invierno")),
    PatternRule("dates_holidays", (r"\b(navidad|año nuevo|reyes|semana santa|pascua|carnaval)\b",), "temporal", True, "group", 1, needs=("navidad", "año nuevo", "reyes", "semana santa", "pascua", "carnaval")),
    PatternRule("dates_additional", (
        r"\b(la\s+semana\s+entrante|la\s+semana\s+siguiente|la\s+que\s+viene|dentro\s+de\s+un\s+rato|más\s+tarde|esta\s+tarde|esta\s+noche)\b",
        r"\b(al\s+día\s+siguiente|al\s+siguiente\s+día|al\s+otro\s+día|al\s+dia\s+siguiente)\b",
        r"\b(ultimamente|últimamente|recientemente|hace\s+poco|hace\s+un\s+tiempo)\b",
    ), "temporal", True, "group", 1, needs=("la", "dentro", "tarde", "esta", "día", "dia", "mente", "hace")),
]

RULES = BASIC + MONETARY + DATES
BY_KEY = {r.key: r for r in RULES}

# Named alarm patterns and link patterns offered to users.
ALARM_PATTERNS = {
    "📧 Correos Electrónicos": BY_KEY["emails"].regexes[0],
    "📞 Números de Teléfono": r"\b(?:\+\d{1,3}[\s\-]?)?(?:\(\d+\)[\s\-]?)?\d{3,4}[\s\-]?\d{3,4}[\s\-]?\d{0,4}\b",
    "#️⃣ Hashtags": BY_KEY["hashtags"].regexes[0],
    "@️⃣ Menciones": BY_KEY["mentions"].regexes[0],
    "💳 Tarjetas de Crédito": BY_KEY["credit_cards"].regexes[0],
    "📍 Coordenadas": BY_KEY["coordinates"].regexes[0],
    "🌐 Direcciones IP": BY_KEY["ip_addresses"].regexes[0],
    "₿ Direcciones Cripto": BY_KEY["crypto_addresses"].regexes[0],
    "📚 Códigos ISBN": BY_KEY["isbn_codes"].regexes[0],
    "🚗 Placas de Vehículos": BY_KEY["vehicle_plates"].regexes[0],
    "📏 Medidas": BY_KEY["measurements"].regexes[0],
    "📊 Porcentajes": BY_KEY["percentages"].regexes[0],
    "🗓️ Fechas absolutas": BY_KEY["dates_absolute"].regexes[0],
    "🗓️ Fechas español": BY_KEY["dates_spanish_format"].regexes[0],
    "💰 Precios explícitos": rf"\b{NUMBER}\s*(?:{CURRENCIES})\b",
    "💰 Precios con $": rf"\$\s?{NUMBER}\s*(?:mlc|mn|usd)?\b",
    "💰 Rangos de precios": r"\b\d+\s*-\s*\d+\s*(?:mlc|mn|usd|dólares|dolares|pesos)",
}
_LINK_HOSTS = [
    ("🛒", "Amazon", r"amazon\.[a-z.]{2,6}"), ("💬", "Discord", r"discord(?:app)?\.com"),
    ("👥", "Facebook", r"facebook\.com"), ("📸", "Flickr", r"flickr\.com"),
    ("🎬", "Likee", r"likee\.video"), ("💼", "LinkedIn", r"linkedin\.com"),
    ("📝", "Medium", r"medium\.com"), ("📌", "Pinterest", r"pinterest\.com"),
    ("👾", "Reddit", r"reddit\.com"), ("👻", "Snapchat", r"snapchat\.com"),
    ("💻", "StackOverflow", r"stackoverflow\.com"), ("🧵", "Threads", r"threads\.net"),
    ("📝", "Tumblr", r"tumblr\.com"), ("🐦", "Twitter/X", r"(?:twitter|x)\.com"),
    ("🎬", "YouTube", r"(?:youtube\.com|youtu\.be)"), ("💻", "GitHub", r"github\.com"),
    ("💻", "GitLab", r"gitlab\.com"), ("🔍", "Google", r"google\.com"),
    ("🖼️", "Imgur", r"imgur\.com"), ("📷", "Instagram", r"instagram\.com"),
]
LINK_PATTERNS = {
    f"{emoji} Enlaces de {site}": rf"https?://(?:www\.)?{host}/[^\s]+" for emoji, site, host in _LINK_HOSTS
}
LINK_PATTERNS["💬 Enlaces de WhatsApp"] = r"https?://(?:wa\.me/|whatsapp\.com/)[^\s]+"
PREDEFINED = {**ALARM_PATTERNS, **LINK_PATTERNS}
