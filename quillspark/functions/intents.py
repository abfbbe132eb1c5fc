"""Intents of questions, answers without a generator, and prompts, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import strip

# Terms of each intent. A term counts wherever it occurs, inside words too.
WEB = ["오늘", "현재", "최신", "최근", "실시간", "지금", "올해", "날씨", "뉴스", "환율", "주가", "시세", "속보", "today", "current", "latest", "recent", "now", "weather", "news", "stock", "price", "score", "live", "검색", "search", "look up", "find out"]
WHOLE_DOCUMENT = ["요약", "요약해", "정리", "정리해", "전체", "전반", "구조", "목차", "분석", "분석해", "핵심", "주요 내용", "전체 내용", "섹션", "section", "structure", "outline", "overview", "summarize", "summary", "analyze", "analysis", "key points", "main points", "extract key", "extract data", "important information", "important info"]
SMALL_TALK = ["안녕", "고마워", "감사", "오케이", "알겠", "응", "네", "hello", "hi", "thanks", "thank you", "okay", "ok", "got it"]
EXTRACTION = ["텍스트 추출", "문자 추출", "글자 추출", "읽어줘", "텍스트만", "원문", "ocr", "what does this image say", "what does the image say", "give me the text", "extract the text", "read the text", "read this image", "text in the image", "transcribe"]
REFUSAL = ["couldn't find relevant information", "not found in the document", "제공된 문서에서 확인되지 않습니다", "질문과 관련된 정보를 찾지 못했습니다"]
NOT_FOUND_KO = "업로드된 문서 '%s'에서 질문과 관련된 정보를 찾지 못했습니다. 질문을 조금 더 구체적으로 해주세요."
NOT_FOUND_EN = "I couldn't find relevant information in the uploaded document '%s'. Please try a more specific question."
EXTRACTED_KO, EXTRACTED_EN = "추출된 텍스트:", "Extracted text:"

THRESHOLD, SINGLE_UPLOAD_THRESHOLD = 0.45, 0.30
SMALL_DOC_CHUNKS = 3
SYSTEM = "Answer from the documents given, in the language of the question; say so if they do not tell."


def pattern(terms: list[str], word_boundary: bool = False) -> str:
    any_ = "|".join(map(re.escape, terms))
    return rf"\b(?:{any_})\b" if word_boundary else any_


def mentions(text: Column, terms: list[str], word_boundary: bool = False) -> Column:
    """Whether the lower-cased text holds any of the terms; false for null."""
    return F.coalesce(F.lower(text).rlike(pattern(terms, word_boundary)), F.lit(False))


def some(c: Column) -> Column:
    """Null for the empty string."""
    return F.when(c != "", c)


def hangul(text: Column) -> Column:
    return F.coalesce(text.rlike("[가-힣]"), F.lit(False))


def not_found(question: Column, source: Column, doc_id: Column) -> Column:
    name = F.coalesce(some(source), some(doc_id), F.lit("the uploaded document"))
    return F.when(hangul(question), F.format_string(NOT_FOUND_KO, name)).otherwise(F.format_string(NOT_FOUND_EN, name))


def extracted(text: Column) -> Column:
    """The answer to a request for the text itself; null where there is none."""
    t = some(strip(text))
    return F.concat(F.when(hangul(t), EXTRACTED_KO).otherwise(EXTRACTED_EN), F.lit("\n\n"), t)


def threshold(n_docs: Column, source_type: Column) -> Column:
    return F.when((n_docs == 1) & (source_type == "upload"), SINGLE_UPLOAD_THRESHOLD).otherwise(THRESHOLD)


def rejected(n_docs: Column, confidence: Column, strong: Column, limit: Column) -> Column:
    """Whether a scoped question gets the not-found answer: no chunks, or too little confidence and no strong hit."""
    return (F.coalesce(n_docs, F.lit(0)) == 0) | ((confidence < limit) & ~F.coalesce(strong, F.lit(False)))


def small_document(n_chunks: Column) -> Column:
    return F.coalesce((n_chunks > 0) & (n_chunks <= SMALL_DOC_CHUNKS), F.lit(False))


def mode(context: Column, web: Column) -> Column:
    has, net = F.coalesce(context, F.lit("")) != "", F.coalesce(web, F.lit("")) != ""
    return F.when(has & net, "document_qa+web").when(net, "web_search").when(has, "document_qa").otherwise("general")


def prompt(question: Column, history: Column, context: Column, web: Column, system: Column, default: str = SYSTEM) -> Column:
    """Sections with their titles, empty ones left out."""
    section = lambda title, c: F.concat(F.lit(f"[{title}]\n"), c)
    return F.concat_ws("\n\n", section("System", F.coalesce(some(system), F.lit(default))), section("Conversation history", some(history)), section("Retrieved document context", some(context)), section("Web search results", some(web)), section("User message", F.coalesce(question, F.lit(""))))
