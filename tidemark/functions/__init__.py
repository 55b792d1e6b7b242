from tidemark.functions.columns import columns_of, fold, resolve
from tidemark.functions.compare import lex_gt, lex_lt
from tidemark.functions.literals import decode, encode, quote, sql_text
from tidemark.functions.rules import Rule, allowed, not_blank, positive, requires, violation
from tidemark.functions.text import identifier, is_blank, split_columns, split_columns_of

__all__ = [
    "Rule", "allowed", "columns_of", "decode", "encode", "fold", "identifier", "is_blank",
    "lex_gt", "lex_lt", "not_blank", "positive", "quote", "requires", "resolve", "split_columns",
    "split_columns_of", "sql_text", "violation",
]
