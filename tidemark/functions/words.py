"""Folder and country names in three languages (fixed values), and lookups with fallback."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = ("en", "ru", "ja")
FOLDERS = {
    "unsorted": ("_Unsorted", "_Неразобрано", "_未分類"),
    "documents": ("_Documents", "_Документы", "_書類"),
    "duplicates": ("_Duplicates", "_Дубликаты", "_重複"),
    "shared": ("_Shared", "_Совместные", "_共有"),
    "junk": ("junk", "мусор", "ゴミ"),
    "no_place": ("no_place", "без_места", "場所不明"),
    "low_date": ("low_date", "без_даты", "日付不明"),
    "not_personal": ("not_personal", "не_личное", "非個人"),
    "no_event": ("no_event", "без_события", "イベント不明"),
    "no_faces": ("no_faces", "без_лиц", "顔なし"),
    "document": ("document", "документ", "書類"),
    "products": ("_Products", "_Товары", "_商品"),
    "to_delete": ("_delete", "_удалить", "_削除"),
}
COUNTRIES = {
    "ru": ("Russia", "Россия", "ロシア"), "th": ("Thailand", "Таиланд", "タイ"), "id": ("Indonesia", "Индонезия", "インドネシア"),
    "tr": ("Turkey", "Турция", "トルコ"), "ae": ("United Arab Emirates", "ОАЭ", "アラブ首長国連邦"), "us": ("United States", "США", "アメリカ合衆国"),
    "gb": ("United Kingdom", "Великобритания", "イギリス"), "de": ("Germany", "Германия", "ドイツ"), "fr": ("France", "Франция", "フランス"),
    "it": ("Italy", "Италия", "イタリア"), "es": ("Spain", "Испания", "スペイン"), "jp": ("Japan", "Япония", "日本"), "cn": ("China", "Китай", "中国"),
    "ge": ("Georgia", "Грузия", "ジョージア"), "am": ("Armenia", "Армения", "アルメニア"), "az": ("Azerbaijan", "Азербайджан", "アゼルバイジャン"),
    "kz": ("Kazakhstan", "Казахстан", "カザフスタン"), "vn": ("Vietnam", "Вьетнам", "ベトナム"), "kr": ("South Korea", "Южная Корея", "韓国"),
    "in": ("India", "Индия", "インド"), "gr": ("Greece", "Греция", "ギリシャ"), "eg": ("Egypt", "Египет", "エジプト"), "cy": ("Cyprus", "Кипр", "キプロス"),
    "il": ("Israel", "Израиль", "イスラエル"), "nl": ("Netherlands", "Нидерланды", "オランダ"), "pt": ("Portugal", "Португалия", "ポルトガル"),
    "ch": ("Switzerland", "Швейцария", "スイス"), "at": ("Austria", "Австрия", "オーストリア"), "cz": ("Czechia", "Чехия", "チェコ"),
    "pl": ("Poland", "Польша", "ポーランド"), "fi": ("Finland", "Финляндия", "フィンランド"), "se": ("Sweden", "Швеция", "スウェーデン"), "no": ("Norway", "Норвегия", "ノルウェー"),
}


def language(code: str | None) -> str:
    code = (code or "").lower()
    return code if code in LANGUAGES else "en"


def folder(key: str, lang: str = "en") -> str:
    return FOLDERS[key][LANGUAGES.index(language(lang))] if key in FOLDERS else key


def country(cc: Column, lang: str = "en") -> Column:
    """The country's name, else the code itself."""
    k = LANGUAGES.index(language(lang))
    known = F.create_map(*[F.lit(x) for code, names in COUNTRIES.items() for x in (code, names[k])])
    return F.coalesce(F.try_element_at(known, F.lower(cc)), cc)
