"""The pattern language: lexer, parser, resolver."""
