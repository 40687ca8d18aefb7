"""Local grammars: whether a file's tokens are a whole file of their language.

Declarations and statements are read by recursive descent. What a statement is made of depends only on its tokens' classes, so a
statement up to its semicolon is checked once for each sequence of classes and remembered: names are i, numbers 0, strings s, characters
c. Types, scopes and what a file includes are not looked at. Names that may be types are read as types wherever that makes sense.
"""

from __future__ import annotations

import ast
import contextlib
import json
import re
import sys
import warnings
from collections.abc import Iterator

from keelson.llm.lexers import lex


class Bad(Exception):
    pass


_memo: dict = {}


def remembered(name: str, tokens: list[str], check) -> None:
    """Run check over tokens, or raise or pass as it did the last time on the same ones."""
    key = name + " ".join(tokens)
    known = _memo.get(key)
    if known is None:
        if len(_memo) > 200_000:
            _memo.clear()
        try:
            check(tokens)
            known = True
        except Bad:
            known = False
        _memo[key] = known
    if not known:
        raise Bad


_PAIRS = {"(": ")", "[": "]", "{": "}"}
_OPENING, _CLOSING = {"(", "[", "{"}, {")", "]", "}"}


class Reader:
    """Tokens with a place; an empty string is the end."""

    def __init__(self, tokens: list[str]):
        self.t = [*tokens, "", "", ""]
        self.i = 0
        self.n = len(tokens)

    @property
    def tok(self) -> str:
        return self.t[self.i]

    def ahead(self, k: int = 1) -> str:
        return self.t[min(self.i + k, self.n)]

    def take(self, *want: str) -> bool:
        if self.t[self.i] in want and self.i < self.n:
            self.i += 1
            return True
        return False

    def need(self, *want: str) -> None:
        if not self.take(*want):
            raise Bad

    def done(self) -> None:
        if self.i < self.n:
            raise Bad

    def attempt(self, rule, *args) -> bool:
        """Run rule; if it fails, be where we were."""
        at = self.i
        try:
            rule(*args)
            return True
        except Bad:
            self.i = at
            return False

    def balanced(self) -> None:
        """Skip a bracketed group."""
        pairs = _PAIRS
        if self.tok not in pairs:
            raise Bad
        stack = []
        for at in range(self.i, self.n):
            t = self.t[at]
            if t in pairs:
                stack.append(pairs[t])
            elif t in _CLOSING:
                if stack.pop() != t:
                    raise Bad
                if not stack:
                    self.i = at + 1
                    return
        raise Bad

    def simple(self) -> list[str]:
        """The tokens up to a semicolon outside brackets, without it; the place moves behind it."""
        depth, start, tokens = 0, self.i, self.t
        for at in range(start, self.n):
            t = tokens[at]
            if t in _OPENING:
                depth += 1
            elif t in _CLOSING:
                depth -= 1
                if depth < 0:
                    raise Bad
            elif t == ";" and not depth:
                self.i = at + 1
                return tokens[start:at]
        raise Bad


# ---------------------------------------------------------------- C and C++

#: Key words of C and C++, and the levels of their binary operators.
_C_TYPES = set("void char short int long float double signed unsigned _Bool _Complex _Imaginary __int128".split())
_C_QUALS = set("const volatile restrict _Atomic __restrict __restrict__ __const __volatile__ static extern register auto typedef inline __inline __inline__ _Noreturn _Thread_local __thread __extension__".split())
_C_STATEMENTS = set("if else for while do switch case default break continue return goto".split())
_C_WORDS = _C_TYPES | _C_QUALS | _C_STATEMENTS | set("struct union enum sizeof _Alignof _Alignas _Generic _Static_assert __attribute__ asm __asm__ __asm typeof __typeof__".split())
_CPP_ONLY = set(
    "bool wchar_t char8_t char16_t char32_t class namespace template typename using public private protected virtual explicit friend mutable constexpr consteval constinit operator new delete this throw try catch "
    "static_cast dynamic_cast const_cast reinterpret_cast nullptr true false noexcept decltype static_assert alignas alignof typeid thread_local concept requires co_await co_return co_yield and or not xor bitand bitor compl and_eq or_eq xor_eq not_eq".split()
)
_C_ATTRIBUTES = {"[", "__attribute__", "alignas", "_Alignas", "__declspec", "asm", "__asm__", "__asm"}
_BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "<=>": 8, "<<": 9, ">>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, ".*": 12, "->*": 12, "or": 1, "and": 2, "bitor": 3, "xor": 4, "bitand": 5, "not_eq": 6}
_ASSIGN = set("= += -= *= /= %= &= |= ^= <<= >>= and_eq or_eq xor_eq".split())


class C(Reader):
    cpp = False
    tag = "C."

    # -- types

    def attributes(self) -> None:
        while self.t[self.i] in _C_ATTRIBUTES:
            if self.tok == "[" and self.ahead() == "[":
                self.balanced()
            elif self.tok in ("__attribute__", "alignas", "_Alignas", "__declspec"):
                self.i += 1
                self.balanced()
            elif self.tok in ("asm", "__asm__", "__asm") and self.ahead() == "(":
                self.i += 1
                self.balanced()
            else:
                return

    def name(self) -> None:
        """A possibly qualified name, in C++ with template arguments."""
        if not self.cpp:
            return self.need("i")
        self.take("::")
        while True:
            if self.take("template"):
                pass
            if self.take("~"):
                self.need("i")
            elif self.tok == "operator":
                self.operator_name()
            elif self.tok == "decltype":
                self.i += 1
                self.balanced()
            else:
                self.need("i")
            if self.tok == "<":
                self.attempt(self.template_arguments)
            if not (self.tok == "::" and self.ahead() in ("i", "~", "operator", "template")):
                return
            self.i += 1

    def operator_name(self) -> None:
        self.need("operator")
        if self.take("new", "delete"):
            if self.take("["):
                self.need("]")
        elif self.take("("):
            self.need(")")
        elif self.take("["):
            self.need("]")
        elif self.take("s"):
            self.take("i")
        elif self.tok in _BINARY or self.tok in _ASSIGN or self.tok in ("!", "~", "++", "--", ",", "->", "->*", "not", "compl", "co_await"):
            self.i += 1
            if self.t[self.i - 1] == ">" and self.tok == ">" and self.ahead() == "(":
                self.i += 1
        else:
            self.specifiers()
            while self.take("*", "&", "&&", "const"):
                pass

    def template_arguments(self) -> None:
        self.need("<")
        if not self.close_angle():
            while True:
                at = self.i
                if not (self.attempt(self.type_name) and (self.take("...") or True) and self.tok in (",", ">", ">>")):
                    self.i = at
                    self.binary(8, angle=True)
                    self.take("...")
                if self.close_angle():
                    break
                self.need(",")

    def close_angle(self) -> bool:
        if self.take(">"):
            return True
        if self.tok == ">>":  # two closing ones
            self.t[self.i] = ">"
            self.t.insert(self.i, ">")
            self.n += 1
            self.i += 1
            return True
        return False

    def specifiers(self, member: bool = False) -> bool:
        """Declaration specifiers, at least one; whether they name a type."""
        start, typed = self.i, False
        while True:
            self.attributes()
            t = self.tok
            if t in _C_TYPES or (self.cpp and t in ("bool", "wchar_t", "char8_t", "char16_t", "char32_t")):
                typed = True
                self.i += 1
            elif t in _C_QUALS:
                typed = typed or (self.cpp and t == "auto")
                self.i += 1
            elif self.cpp and t in ("constexpr", "consteval", "constinit", "virtual", "mutable", "friend", "thread_local", "explicit", "typename"):
                self.i += 1
                if t == "explicit" and self.tok == "(":
                    self.balanced()
            elif t in ("struct", "union") or (self.cpp and t == "class"):
                self.i += 1
                self.record()
                typed = True
            elif t == "enum":
                self.i += 1
                self.enumeration()
                typed = True
            elif t in ("typeof", "__typeof__") or (self.cpp and t == "decltype"):
                self.i += 1
                self.balanced()
                typed = True
            elif t == "_Atomic" and self.ahead() == "(":
                self.i += 1
                self.balanced()
                typed = True
            elif not typed and (t == "i" or (self.cpp and t == "::")):
                if self.cpp and member and self.constructor_ahead():
                    break
                self.name()
                if self.cpp and self.t[self.i - 1] != "i" and self.t[self.i - 1] not in (">", ")"):
                    raise Bad
                typed = True
                if self.cpp and self.tok == "auto":  # a constraint
                    self.i += 1
            else:
                break
        if self.i == start:
            raise Bad
        return typed

    def constructor_ahead(self) -> bool:
        """Whether name( begins a constructor or destructor here and not a type."""
        at, k = self.i, self.i
        if self.t[k] == "::":
            k += 1
        saved = self.i
        try:
            self.name()
            return self.tok == "(" and self.i > at
        except Bad:
            return False
        finally:
            self.i = saved

    def record(self) -> None:
        self.attributes()
        if self.tok == "i" or (self.cpp and self.tok == "::"):
            self.name()
            if self.cpp:
                if self.tok == "i" and self.ahead() in ("{", ":"):
                    self.i += 1  # final
        elif self.tok != "{" and not (self.cpp and self.tok == ":"):
            raise Bad
        if self.cpp and self.tok == ":" and self.ahead() != ":":
            at = self.i
            self.i += 1
            try:
                while True:
                    while self.take("public", "private", "protected", "virtual"):
                        pass
                    self.name()
                    self.take("...")
                    if not self.take(","):
                        break
                if self.tok != "{":
                    raise Bad
            except Bad:
                self.i = at
                return
        if self.take("{"):
            while not self.take("}"):
                self.member()
        self.attributes()

    def member(self) -> None:
        if self.take(";"):
            return
        if self.cpp:
            if self.tok in ("public", "private", "protected") and self.ahead() == ":":
                self.i += 2
                return
            if self.tok == "i" and self.ahead() == ":" and self.t[self.i - 1] in ("{", "}", ";", ":"):
                self.i += 2  # a macro's access label
                return
            return self.external(member=True)
        if self.tok == "_Static_assert":
            self.i += 1
            self.balanced()
            return self.need(";")
        self.specifiers()
        self.declarators(bits=True)
        self.need(";")

    def enumeration(self) -> None:
        if self.cpp:
            self.take("class", "struct")
        self.attributes()
        named = self.tok == "i"
        if named:
            self.name()
        if self.cpp and self.tok == ":":
            self.i += 1
            self.specifiers()
        if self.take("{"):
            while not self.take("}"):
                self.need("i")
                self.attributes()
                if self.take("="):
                    self.conditional()
                if not self.take(","):
                    self.need("}")
                    break
        elif not named:
            raise Bad

    def pointers(self) -> None:
        while True:
            self.attributes()
            if self.take("*"):
                pass
            elif self.cpp and self.take("&", "&&"):
                pass
            elif self.tok in ("const", "volatile", "restrict", "__restrict", "__restrict__", "_Atomic"):
                self.i += 1
            elif self.cpp and self.tok == "i" and self.ahead() == "::" and self.ahead(2) == "*":
                self.i += 3
            else:
                return

    def declarator(self, abstract: bool = False, named: bool = True) -> bool:
        """A declarator; whether it is one of a function. Abstract ones need no name, named ones may have one."""
        self.pointers()
        function = False
        if self.cpp and self.tok == "..." and (abstract or named):
            self.i += 1
        if self.tok == "(" and self.inner_ahead(abstract):
            self.i += 1
            self.attributes()
            self.declarator(abstract, named)
            self.need(")")
        elif named and (self.tok == "i" or (self.cpp and self.tok in ("::", "~", "operator"))):
            self.name()
        elif self.cpp and named and self.tok == "[" and not abstract:  # a structured binding
            self.i += 1
            self.need("i")
            while self.take(","):
                self.need("i")
            self.need("]")
        elif not abstract:
            raise Bad
        self.attributes()
        while True:
            if self.tok == "[" and self.ahead() != "[":
                self.i += 1
                while self.take("static", "const", "volatile", "restrict"):
                    pass
                if self.tok == "*" and self.ahead() == "]":
                    self.i += 1
                elif self.tok != "]":
                    self.assignment()
                self.need("]")
            elif self.tok == "(" and not (self.cpp and not abstract and not self.parameters_ahead()):
                self.parameters()
                function = True
                self.function_tail()
            else:
                return function

    def inner_ahead(self, abstract: bool) -> bool:
        nxt = self.ahead()
        if nxt in ("*", "^") or (self.cpp and nxt in ("&", "&&")):
            return True
        if abstract:
            return nxt in ("(", "[") and self.ahead(2) in ("*", "(")
        return nxt in ("i", "(", "__attribute__")

    def parameters_ahead(self) -> bool:
        """In C++ a declarator's bracket may hold an initialiser instead."""
        at = self.i
        ok = self.attempt(self.parameters)
        self.i = at
        return ok

    def parameters(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        while True:
            if self.take("..."):
                break
            self.attributes()
            self.specifiers()
            self.declarator(abstract=True)
            if self.cpp and self.take("="):
                self.initializer()
            if not self.take(","):
                if self.cpp:
                    self.take("...")
                break
        self.need(")")

    def function_tail(self) -> None:
        if not self.cpp:
            return
        while True:
            self.attributes()
            if self.take("const", "volatile", "&", "&&", "mutable", "constexpr"):
                continue
            if self.tok in ("noexcept", "throw"):
                self.i += 1
                if self.tok == "(":
                    self.balanced()
                continue
            if self.take("override"):
                continue
            if self.take("->"):
                self.type_name()
                continue
            if self.tok == "requires":
                self.i += 1
                self.binary(1)
                continue
            return

    def type_name(self) -> None:
        self.specifiers()
        self.declarator(abstract=True, named=False)

    def declarators(self, bits: bool = False) -> bool:
        """Declarators with initialisers; none is fine. Whether there was one of a function, alone and without an initialiser."""
        if self.tok == ";":
            return False
        function, count = False, 0
        while True:
            count += 1
            if not (bits and self.tok == ":"):
                function = self.declarator()
                self.attributes()
            if bits and self.take(":"):
                self.conditional()
                function = False
            if self.tok == "=":
                self.i += 1
                function = False
                if not (self.cpp and self.take("default", "delete")):
                    self.initializer()
            elif self.cpp and self.tok == "{" and not function:
                self.braces()
            elif self.cpp and self.tok == "(" and not function:
                self.arguments()
            if not self.take(","):
                return function and count == 1

    def initializer(self) -> None:
        if self.tok == "{":
            self.braces()
        else:
            self.assignment()

    def braces(self) -> None:
        self.need("{")
        while not self.take("}"):
            while self.tok in (".", "["):
                if self.cpp and self.tok == "[":
                    break
                if self.take("."):
                    self.need("i")
                else:
                    self.i += 1
                    self.conditional()
                    if self.take("..."):
                        self.conditional()
                    self.need("]")
                if self.tok in (".", "["):
                    continue
                if not self.take("="):
                    if self.tok != "{":
                        raise Bad
                break
            self.initializer()
            if self.cpp:
                self.take("...")
            if not self.take(","):
                self.need("}")
                return

    # -- expressions; each rule says whether it is a unary expression, which alone can be assigned to

    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            if self.cpp and self.tok == "...":  # a fold over commas
                self.i += 1
                if self.take(","):
                    self.unary()
                if self.tok != ")":
                    raise Bad
                return
            self.assignment()

    def assignment(self) -> None:
        if self.cpp and self.take("throw"):
            if self.tok not in (";", ")", ",", ""):
                self.assignment()
            return
        if self.cpp and self.take("co_yield"):
            return self.initializer()
        unary = self.conditional()
        if self.tok in _ASSIGN:
            if not unary:
                raise Bad
            self.i += 1
            if self.cpp or self.tok != "{":
                self.initializer()
            else:
                raise Bad

    def conditional(self) -> bool:
        unary = self.binary(1)
        if self.take("?"):
            if self.tok != ":":
                self.expression()
            elif self.cpp:
                raise Bad
            self.need(":")
            self.assignment()
            return False
        return unary

    def binary(self, level: int, angle: bool = False) -> bool:
        unary = self.unary()
        while True:
            op = self.tok
            own = _BINARY.get(op, 0)
            if own < level or (angle and op in (">", ">>")) or (not self.cpp and op in (".*", "->*", "<=>")) or self.i >= self.n:
                return unary
            if self.cpp and self.ahead() == "...":  # a fold, which goes on behind the dots or ends with its bracket
                self.i += 2
                if self.tok in _BINARY:
                    self.i += 1
                    self.unary()
                if self.tok != ")":
                    raise Bad
                return False
            self.i += 1
            self.binary(own + 1, angle)
            unary = False

    def unary(self) -> bool:
        t = self.tok
        if t in ("++", "--", "&", "*", "+", "-", "~", "!", "&&") or (self.cpp and t in ("not", "compl", "co_await")):
            if t == "&&" and self.ahead() != "i":
                raise Bad
            self.i += 1
            self.unary()
            return True
        if t in ("sizeof", "_Alignof", "alignof", "__extension__", "typeid", "noexcept"):
            self.i += 1
            if self.cpp and self.tok == "...":
                self.i += 1
            if self.tok == "(":
                at = self.i
                self.i += 1
                if self.attempt(self.type_name) and self.take(")"):
                    if self.tok == "{":
                        self.braces()
                        return self.postfix()
                    return True
                self.i = at
            self.unary()
            return True
        if t == "(":
            at = self.i
            self.i += 1
            if self.attempt(self.type_name) and self.take(")"):
                nxt = self.tok
                if nxt == "{":
                    self.braces()
                    return self.postfix()
                simple = self.i - at == 3 and self.t[at + 1] == "i"
                if nxt in ("i", "0", "s", "c", "(", "~", "!", "sizeof", "this", "new", "true", "false", "nullptr", "static_cast", "reinterpret_cast", "const_cast", "dynamic_cast", "_Alignof", "not", "[") or (not simple and nxt in ("*", "&", "-", "+", "++", "--", "::")):
                    if not (nxt == "(" and simple) and not (nxt == "[" and simple):
                        here = self.i
                        try:
                            self.unary()
                            return True
                        except Bad:
                            self.i = here
            self.i = at
        return self.postfix_from()

    def postfix_from(self) -> bool:
        self.primary()
        return self.postfix()

    def postfix(self) -> bool:
        while True:
            if self.take("["):
                if self.cpp and self.tok == "{":
                    self.braces()
                elif self.tok != "]":
                    self.expression()
                self.need("]")
            elif self.tok == "(":
                self.arguments()
            elif self.take(".", "->"):
                if self.cpp:
                    self.take("template")
                    if self.take("*"):
                        self.unary()
                    else:
                        self.name()
                else:
                    self.need("i")
            elif self.take("++", "--"):
                pass
            elif self.cpp and self.tok == "{" and self.t[self.i - 1] in ("i", ">"):
                at = self.i
                if not self.attempt(self.braces):
                    self.i = at
                    return True
                if self.t[self.i] in ("i", "0", "if", "for", "while", "return"):
                    self.i = at
                    return True
            else:
                return True

    def arguments(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        while True:
            if not self.cpp and self.tok in _C_TYPES | {"struct", "union", "enum", "const"}:
                self.type_name()  # of a macro such as va_arg
            else:
                self.initializer()
            if self.cpp:
                self.take("...")
            if not self.take(","):
                break
        self.need(")")

    def primary(self) -> None:
        t = self.tok
        if t in ("0", "c"):
            self.i += 1
            if self.cpp:
                pass
        elif t == "s":
            while self.tok == "s" or (self.tok == "i" and self.ahead() == "s"):
                self.i += 1
            if self.t[self.i - 1] == "s" and self.tok == "i":
                at = self.i
                if self.ahead() not in ("i", "0", "(", "s", "="):
                    self.i += 1  # a macro that is a string
                else:
                    self.i = at
        elif t == "i" or (self.cpp and t in ("::", "operator")):
            self.name()
        elif t == "(":
            self.i += 1
            if self.tok == "{":
                self.block()
            elif self.cpp and self.tok == "...":
                self.i += 1
                if self.tok not in _BINARY and self.tok != ",":
                    raise Bad
                self.i += 1
                self.unary()
            else:
                self.expression()
                if self.cpp:
                    self.take("...")
            self.need(")")
        elif t == "_Generic":
            self.i += 1
            self.balanced()
        elif self.cpp and t in ("this", "true", "false", "nullptr"):
            self.i += 1
        elif self.cpp and t in ("static_cast", "dynamic_cast", "const_cast", "reinterpret_cast"):
            self.i += 1
            self.need("<")
            self.type_name()
            if not self.close_angle():
                raise Bad
            self.need("(")
            self.expression()
            self.need(")")
        elif self.cpp and t == "[":
            self.lambda_()
        elif self.cpp and t == "new":
            self.new()
        elif self.cpp and t == "delete":
            self.i += 1
            if self.take("["):
                self.need("]")
            self.unary()
        elif self.cpp and (t in _C_TYPES or t in ("bool", "auto", "typename", "decltype", "char8_t", "char16_t", "char32_t", "wchar_t", "const")):
            self.specifiers()
            if self.tok == "(":
                self.arguments()
            elif self.tok == "{":
                self.braces()
            elif self.tok != "::":
                raise Bad
            else:
                self.i += 1
                self.name()
        elif self.cpp and t == "requires":
            self.i += 1
            if self.tok == "(":
                self.balanced()
            self.balanced()
        else:
            raise Bad

    def lambda_(self) -> None:
        self.balanced()
        if self.tok == "<":
            self.template_parameters()
        if self.tok == "(":
            self.parameters()
        self.function_tail()
        self.block()

    def new(self) -> None:
        self.need("new")
        if self.tok == "(":
            self.balanced()
        if self.tok in ("(",):
            self.balanced()
        elif self.t[self.i - 1] != ")" or self.tok in ("i", "::") or self.tok in _C_TYPES:
            self.specifiers()
            while self.take("*"):
                pass
        while self.take("["):
            if self.tok != "]":
                self.expression()
            self.need("]")
        if self.tok == "(":
            self.arguments()
        elif self.tok == "{":
            self.braces()

    # -- statements

    def block(self) -> None:
        self.need("{")
        t = self.t
        while t[self.i] != "}":
            self.statement()
        self.i += 1

    def statement(self) -> None:
        t = self.t[self.i]
        if t == "i" and self.t[self.i + 1] != ":":
            return self.checked(type(self).plain)
        self.attributes()
        t = self.t[self.i]
        if t == "{":
            return self.block()
        if t == "if":
            self.i += 1
            if self.cpp and self.take("constexpr", "consteval"):
                pass
            if self.tok == "!" and self.cpp:
                self.i += 1
            if self.tok == "(":
                self.condition()
            elif not self.cpp:
                raise Bad
            self.statement()
            if self.take("else"):
                self.statement()
            return None
        if t in ("while", "switch"):
            self.i += 1
            self.condition()
            return self.statement()
        if t == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.condition()
            return self.need(";")
        if t == "for":
            self.i += 1
            self.head(type(self).for_head)
            return self.statement()
        if t == "case":
            self.i += 1
            self.conditional()
            if self.take("..."):
                self.conditional()
            self.need(":")
            return self.labelled()
        if t == "default":
            self.i += 1
            self.need(":")
            return self.labelled()
        if t in ("break", "continue"):
            self.i += 1
            return self.need(";")
        if t == "goto":
            self.i += 1
            if self.take("*"):
                self.expression()
            else:
                self.need("i")
            return self.need(";")
        if t in ("return", "co_return") and (t == "return" or self.cpp):
            self.i += 1
            return self.checked(type(self).return_value)
        if t == "i" and self.ahead() == ":" and not (self.cpp and self.ahead(2) == ":"):
            self.i += 2
            return self.labelled()
        if t in ("asm", "__asm__", "__asm"):
            self.i += 1
            while self.take("volatile", "__volatile__", "goto", "inline"):
                pass
            self.balanced()
            return self.need(";")
        if self.cpp and t == "try":
            self.i += 1
            return self.try_()
        if t == "else" or not t:
            raise Bad
        if t in ("struct", "union", "enum", "class", "namespace", "using", "template", "static_assert", "_Static_assert", "typedef", "extern"):
            return self.external(local=True)
        self.checked(type(self).plain)

    def labelled(self) -> None:
        if self.tok != "}":
            self.statement()

    def try_(self) -> None:
        if self.take(":"):
            self.mem_initializers()
        self.block()
        if self.tok != "catch":
            raise Bad
        while self.take("catch"):
            self.need("(")
            if not self.take("..."):
                self.specifiers()
                self.declarator(abstract=True)
            self.need(")")
            self.block()

    def head(self, rule) -> None:
        """A bracketed head whose content follows rule."""
        start = self.i
        self.balanced()
        inner = self.t[start + 1 : self.i - 1]
        remembered(f"{self.tag}{rule.__name__} ", inner, lambda x: self.over(x, rule))

    def over(self, tokens: list[str], rule) -> None:
        own = type(self)(tokens)
        rule(own)
        own.done()

    def checked(self, rule) -> None:
        """A statement up to its semicolon whose content follows rule."""
        tokens = self.simple()
        if not _memo.get(f"{self.tag}{rule.__name__} {' '.join(tokens)}"):
            remembered(f"{self.tag}{rule.__name__} ", tokens, lambda x: self.over(x, rule))

    def condition(self) -> None:
        self.head(type(self).condition_content)

    def condition_content(self) -> None:
        if self.cpp:
            at = self.i
            try:
                self.expression()
                if self.i == self.n:
                    return
            except Bad:
                pass
            self.i = at
            if self.attempt(self.init_part):
                if self.i == self.n:
                    return
                at = self.i
                if self.attempt(self.expression) and self.i == self.n:
                    return
                self.i = at
            else:
                self.i = at
            self.specifiers()
            self.declarator()
            if self.take("="):
                self.initializer()
            else:
                self.braces()
            return
        self.expression()

    def init_part(self) -> None:
        if self.tok != ";":
            at = self.i
            if not (self.attempt(self.expression) and self.tok == ";"):
                self.i = at
                self.declaration_content()
        self.need(";")

    def for_head(self) -> None:
        if self.cpp:
            at = self.i
            try:
                if ";" in self.t:
                    self.attempt(self.init_part)
                self.specifiers()
                self.declarator()
                self.need(":")
                self.initializer()
                if self.i == self.n:
                    return
            except Bad:
                pass
            self.i = at
        self.init_part()
        if self.tok != ";":
            self.expression()
        self.need(";")
        if self.i < self.n:
            self.expression()

    def return_value(self) -> None:
        if self.i < self.n:
            if self.cpp:
                self.initializer()
                while self.take(","):
                    self.assignment()
            else:
                self.expression()

    def declaration_content(self) -> None:
        self.specifiers()
        self.declarators()

    def plain(self) -> None:
        """An expression, a declaration, or nothing."""
        if not self.n:
            return
        if self.tok not in _C_TYPES and self.tok not in _C_QUALS:
            if self.attempt(self.expression) and self.i == self.n:
                return
            self.i = 0
        self.declaration_content()

    # -- declarations outside functions

    def unit(self) -> None:
        while self.i < self.n:
            self.external()

    def external(self, local: bool = False, member: bool = False) -> None:
        if self.take(";"):
            return
        self.attributes()
        t = self.tok
        if t in ("_Static_assert", "static_assert"):
            self.i += 1
            self.balanced()
            return self.need(";")
        if t in ("asm", "__asm__", "__asm"):
            self.i += 1
            self.balanced()
            return self.need(";")
        if self.cpp:
            if t == "inline" and self.ahead() == "namespace":
                self.i += 1
                t = "namespace"
            if t == "namespace":
                self.i += 1
                self.attributes()
                if self.take("i"):
                    while self.take("::"):
                        self.take("inline")
                        self.need("i")
                    self.attributes()
                    if self.take("="):
                        self.name()
                        return self.need(";")
                self.need("{")
                while not self.take("}"):
                    self.external()
                return None
            if t == "using":
                self.i += 1
                if self.take("namespace"):
                    self.name()
                elif self.take("enum"):
                    self.name()
                else:
                    self.take("typename")
                    self.name()
                    self.attributes()
                    if self.take("="):
                        self.type_name()
                    else:
                        while self.take(","):
                            self.take("typename")
                            self.name()
                return self.need(";")
            if t == "template":
                self.i += 1
                if self.tok == "<":
                    self.template_parameters()
                if self.take("requires"):
                    self.binary(1)
                return self.external(local, member)
            if t == "concept":
                self.i += 1
                self.need("i")
                self.need("=")
                self.expression()
                return self.need(";")
            if t == "extern" and self.ahead() == "s":
                self.i += 2
                if self.take("{"):
                    while not self.take("}"):
                        self.external()
                    return None
                return self.external()
            if t == "friend" and self.ahead() in ("class", "struct"):
                self.i += 2
                self.name()
                return self.need(";")
            if self.special_member():
                return None
        self.specifiers(member)
        function = self.declarators(bits=member) if self.tok != ";" else False
        if function and self.tok == "{":
            if local:
                raise Bad
            return self.block()
        if function and self.cpp and self.tok in ("try", ":"):
            return self.function_body()
        if function and not self.cpp and self.tok not in (";", ","):
            while self.tok != "{":  # parameters declared before the body
                self.specifiers()
                self.declarators()
                self.need(";")
            return self.block()
        self.need(";")

    def special_member(self) -> bool:
        """A constructor, destructor or conversion, which has no type."""
        at = self.i
        try:
            while self.tok in ("inline", "explicit", "constexpr", "virtual", "static", "consteval", "friend"):
                explicit = self.tok == "explicit"
                self.i += 1
                if explicit and self.tok == "(":
                    self.balanced()
            self.attributes()
            if self.tok not in ("i", "~", "operator", "::"):
                raise Bad
            self.name()
            if self.tok != "(":
                raise Bad
            self.parameters()
            self.function_tail()
            if self.take("="):
                if not self.take("default", "delete"):
                    self.need("0")
                self.need(";")
            elif self.tok in (":", "try", "{"):
                self.function_body()
            else:
                self.need(";")
            return True
        except Bad:
            self.i = at
            return False

    def function_body(self) -> None:
        if self.take("try"):
            return self.try_()
        if self.take(":"):
            self.mem_initializers()
        self.block()

    def mem_initializers(self) -> None:
        while True:
            self.name()
            if self.tok == "(":
                self.arguments()
            else:
                self.braces()
            self.take("...")
            if not self.take(","):
                return

    def template_parameters(self) -> None:
        self.need("<")
        while not self.close_angle():
            if self.tok == "template":
                self.i += 1
                self.template_parameters()
                self.need("typename", "class")
                self.take("...")
                self.take("i")
                if self.take("="):
                    self.name()
            elif self.tok in ("typename", "class") and self.ahead() in ("i", ",", ">", "=", "..."):
                self.i += 1
                self.take("...")
                self.take("i")
                if self.take("="):
                    self.type_name()
            else:
                self.specifiers()
                self.take("...")
                self.declarator(abstract=True)
                if self.take("="):
                    self.binary(8, angle=True)
            if self.tok not in (">", ">>"):
                self.need(",")


class Cpp(C):
    cpp = True
    tag = "Cpp."


_DIRECTIVE = re.compile(r"[ \t\f\v]*(?:#|%:)\s*([a-z_]*)\s*(.*)", re.DOTALL)


def preprocessed(lang: str, tokens: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The tokens that are left when no macro of the build is defined; macros of the file are expanded."""
    macros: dict[str, tuple[list[str] | None, list[tuple[str, str]]]] = {}
    out: list[tuple[str, str]] = []
    stack: list[list[bool]] = []  # whether the branch is read, whether a branch was, whether else was seen
    run: list[tuple[str, str]] = []

    def flush() -> None:
        out.extend(expand(run, macros) if macros and not macros.keys().isdisjoint([t for _, t in run]) else run)
        run.clear()

    live = True
    at = 0
    for here in [*[i for i, token in enumerate(tokens) if token[0] == "d"], len(tokens)]:
        if live and here > at:
            run += tokens[at:here]
        if here == len(tokens):
            break
        at = here + 1
        text = tokens[here][1]
        word, rest = _DIRECTIVE.match(re.sub(r"\\\r?\n", " ", text)).groups()
        if word in ("if", "ifdef", "ifndef"):
            value = False
            if live:
                if word == "if":
                    value = truth(lang, rest, macros)
                else:
                    name = re.match(r"\w+", rest)
                    if not name:
                        raise Bad
                    value = (name.group() in macros) == (word == "ifdef")
            stack.append([value, value or not live, False])
            live = live and value
        elif word in ("elif", "elifdef", "elifndef", "else"):
            if not stack or stack[-1][2]:
                raise Bad
            top = stack[-1]
            above = all(s[0] for s in stack[:-1])
            if word == "else":
                top[2] = True
                top[0] = above and not top[1]
            else:
                value = above and not top[1] and (truth(lang, rest, macros) if word == "elif" else (rest.split()[0] in macros if rest.split() else False) == (word == "elifdef"))
                top[0] = value
            top[1] = top[1] or top[0]
            live = above and top[0]
        elif word == "endif":
            if not stack:
                raise Bad
            stack.pop()
            live = all(x[0] for x in stack)
        elif live:
            if word == "define":
                flush()
                m = re.match(r"([^\W\d]\w*)(\(([^)]*)\))?", rest)
                if not m:
                    raise Bad
                body = lex(lang, rest[m.end() :], directives=False)[0]
                names = None if m.group(2) is None else [p.strip() for p in m.group(3).split(",")] if m.group(3).strip() else []
                macros[m.group(1)] = (names, body)
            elif word == "undef":
                flush()
                macros.pop(rest.strip(), None)
            elif word not in ("include", "include_next", "import", "pragma", "line", "error", "warning", "ident", "embed", ""):
                raise Bad
    if stack:
        raise Bad
    flush()
    return out


def truth(lang: str, text: str, macros: dict) -> bool:
    """The value of a condition; names that aren't macros are 0."""
    text = re.sub(r"/\*.*?\*/|//.*", " ", text, flags=re.DOTALL)
    text = re.sub(r"\bdefined\s*(?:\(\s*(\w+)\s*\)|(\w+))", lambda m: "1" if (m.group(1) or m.group(2)) in macros else "0", text)
    text = re.sub(r"\b__has_\w+\s*\([^)]*\)", "0", text)
    tokens = expand(lex(lang, text, directives=False)[0], macros)
    if not tokens:
        raise Bad
    out = []
    for kind, t in tokens:
        if kind == "i":
            out.append({"true": "1", "and": " and ", "or": " or ", "not": " not "}.get(t, "0"))
        elif kind == "n":
            m = re.match(r"0[xX][0-9a-fA-F']+|0[bB][01']+|[0-9']+", t)
            out.append(str(int(m.group().replace("'", ""), 0)) if m and not re.match(r"0\d", m.group()) else str(int(m.group(), 8)) if m and re.fullmatch("[0-7]+", m.group()) else "0")
        elif kind == "h":
            out.append("1")
        else:
            out.append({"&&": " and ", "||": " or ", "!": " not ", "/": "//", "?": " and ", ":": " or "}.get(t, t))
    try:
        tree = ast.parse("".join(out).strip(), mode="eval")
        if any(not isinstance(x, (ast.Expression, ast.BoolOp, ast.UnaryOp, ast.BinOp, ast.Compare, ast.Constant, ast.operator, ast.unaryop, ast.boolop, ast.cmpop)) for x in ast.walk(tree)):
            raise Bad
        return bool(eval(compile(tree, "", "eval"), {}))  # only numbers and operators
    except (SyntaxError, ZeroDivisionError, ValueError, OverflowError, MemoryError, RecursionError):
        raise Bad from None


def expand(tokens: list[tuple[str, str]], macros: dict) -> list[tuple[str, str]]:
    """tokens with macros replaced. What a macro gives is read with its name hidden, so there are at most as many levels as macros."""
    out: list[tuple[str, str]] = []
    hidden: frozenset = frozenset()
    i, n = 0, len(tokens)
    above = []  # what is left of the tokens around
    while True:
        if i >= n:
            if not above:
                return out
            tokens, i, n, hidden = above.pop()
            continue
        kind, t = tokens[i]
        own = macros.get(t) if kind == "i" and t not in hidden else None
        i += 1
        if own is None:
            out.append((kind, t))
            continue
        names, body = own
        if names is None:
            above.append((tokens, i, n, hidden))
            tokens, i, hidden = _pasted(body), 0, hidden | {t}
            n = len(tokens)
            continue
        if i >= n or tokens[i][1] != "(" or tokens[i][0] != "o":
            out.append((kind, t))
            continue
        level, args, cur = 0, [], []
        i += 1
        while i < n:
            k, x = tokens[i]
            i += 1
            if k == "o" and x in "([{":
                level += 1
            elif k == "o" and x in ")]}":
                if not level and x == ")":
                    break
                level -= 1
            if k == "o" and x == "," and not level:
                args.append(cur)
                cur = []
            else:
                cur.append((k, x))
        else:
            raise Bad
        args.append(cur)
        variadic = bool(names) and names[-1].endswith("...")
        if variadic:
            fixed = len(names) - 1
            rest: list[tuple[str, str]] = []
            for j, a in enumerate(args[fixed:]):
                rest += [("o", ",")] * (j > 0) + a
            args = [*args[:fixed], rest]
        keys = ["__VA_ARGS__" if x == "..." else x.removesuffix("...").strip() for x in names]
        given = dict(zip(keys, args))
        filled: list[tuple[str, str]] = []
        j = 0
        while j < len(body):
            k, x = body[j]
            if k == "o" and x == "#" and j + 1 < len(body) and body[j + 1][1] in given:
                filled.append(("s", '""'))
                j += 2
                continue
            if k == "i" and x in given:
                filled.extend(given[x])
            else:
                filled.append((k, x))
            j += 1
        above.append((tokens, i, n, hidden))
        tokens, i, hidden = _pasted(filled), 0, hidden | {t}
        n = len(tokens)


def _pasted(tokens: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Tokens with those on both sides of ## joined."""
    if ("o", "##") not in tokens:
        return tokens
    out: list[tuple[str, str]] = []
    i = 0
    while i < len(tokens):
        if tokens[i] == ("o", "##"):
            if out and i + 1 < len(tokens):
                a, b = out.pop(), tokens[i + 1]
                out.append((a[0] if a[0] in "in" else b[0], a[1] + b[1]))
                i += 1
        else:
            out.append(tokens[i])
        i += 1
    return out


def _classes(tokens: list[tuple[str, str]], words: set[str]) -> list[str]:
    """The class of each token; a token that fits nothing makes the file bad."""
    out = [t if kind == "o" or (kind == "i" and t in words) else _CLASS[kind] for kind, t in tokens]
    if "" in out or any(kind == "n" and t[0] == "0" and _NOT_OCTAL(t) for kind, t in tokens):
        raise Bad
    return out


#: A whole number with a leading 0 and a digit that octal numbers don't have.
_NOT_OCTAL = re.compile(r"0[\d_']*[89][\d_']*[uUlLzZ]*$").match


_CLASS = {"i": "i", "n": "0", "s": "s", "h": "c", "x": "", "d": "", "l": ""}


def _c_family(lang: str, tokens: list[tuple[str, str]]) -> None:
    left = preprocessed(lang, tokens)
    if lang == "c":
        return C(_classes(left, _C_WORDS)).unit()
    left = _contextual(left)
    Cpp(_classes(left, _C_WORDS | _CPP_ONLY | {"override"})).unit()


#: What may stand before override and final behind a function's parameters, and after them.
_BEFORE_OVERRIDE, _AFTER_OVERRIDE = set(") const volatile noexcept & && > override final".split()), set("{ ; = override final".split())


def _contextual(tokens: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Tokens of C++ without what modules add, and with override and final as one word where they are specifiers, else as names.

    Lines of modules stand where a declaration begins. A group of exported declarations is read like a namespace.
    """
    words = {t for kind, t in tokens if kind == "i"}
    if not words & {"override", "final", "module", "import", "export"}:
        return tokens
    out: list[tuple[str, str]] = []
    i, n = 0, len(tokens)
    text = lambda k: tokens[k][1] if k < n else ""
    while i < n:
        kind, t = tokens[i]
        begins = not out or out[-1][1] in (";", "{", "}")
        if kind == "i" and t in ("override", "final"):
            special = out and out[-1][1] in _BEFORE_OVERRIDE and text(i + 1) in _AFTER_OVERRIDE
            out.append(("i", "override" if special else f"{t}_"))
        elif kind == "i" and begins and t == "export" and text(i + 1) == "{":
            out.append(("i", "namespace"))
        elif kind == "i" and begins and t == "export":
            pass
        elif kind == "i" and begins and ((t == "module" and (text(i + 1) in (";", ":") or tokens[i + 1][0] == "i")) or (t == "import" and i + 1 < n and (tokens[i + 1][0] in "is" or text(i + 1) in "<:"))):
            while i < n and text(i) != ";":
                i += 1
        else:
            out.append((kind, t))
        i += 1
    return out


# ---------------------------------------------------------------- Java

#: Reserved words of Java.
_JAVA_PRIMITIVE = set("boolean byte short int long char float double".split())
_JAVA_MODIFIER = set("public protected private static abstract final native synchronized transient volatile strictfp default".split())
_JAVA_WORDS = _JAVA_PRIMITIVE | _JAVA_MODIFIER | set("assert break case catch class const continue do else enum extends finally for goto if implements import instanceof interface new package return super switch this throw throws try void while true false null _".split())
#: Words with a meaning in places only; their text is kept.
_JAVA_SOFT = set("var record sealed permits yield when non".split())
_JAVA_BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
_JAVA_ASSIGN = set("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())


class Java(Reader):
    def ident(self) -> None:
        if self.tok == "i" or self.tok in _JAVA_SOFT:
            self.i += 1
        else:
            raise Bad

    def is_ident(self, k: int = 0) -> bool:
        return self.ahead(k) == "i" or self.ahead(k) in _JAVA_SOFT

    def qualified(self) -> None:
        self.ident()
        while self.tok == "." and self.is_ident(1):
            self.i += 2

    def unit(self) -> None:
        at = self.i
        self.modifiers()
        if self.take("package"):
            self.qualified()
            self.need(";")
        else:
            self.i = at
        while self.i < self.n:
            if self.take(";"):
                continue
            if self.take("import"):
                self.take("static")
                self.qualified()
                if self.take("."):
                    self.need("*")
                self.need(";")
                continue
            break
        while self.i < self.n:
            if self.take(";"):
                continue
            self.modifiers()
            if not self.type_declaration():
                raise Bad

    def module(self, tokens: list[tuple[str, str]]) -> None:
        """A file that declares a module: imports, annotations, and directives, whose words mean something here alone."""
        at = next(k for k, (_, t) in enumerate(tokens) if t == "module")
        while self.i < at:
            if self.take("import"):
                self.take("static")
                self.qualified()
                if self.take("."):
                    self.need("*")
                self.need(";")
            elif self.tok == "@":
                self.annotation()
            elif not self.take(";"):
                if self.i != at - 1 or tokens[self.i][1] != "open":
                    raise Bad
                self.i += 1
        self.i = at + 1
        self.qualified()
        self.need("{")
        while not self.take("}"):
            word = tokens[self.i][1] if self.i < self.n else ""
            if word not in ("requires", "exports", "opens", "uses", "provides"):
                raise Bad
            self.i += 1
            if word == "requires":
                while self.tok == "static" or (self.i < self.n and tokens[self.i][1] == "transitive" and self.ahead() == "i"):
                    self.i += 1
            self.qualified()
            joint = {"exports": "to", "opens": "to", "provides": "with"}.get(word)
            if joint and self.i < self.n and tokens[self.i][1] == joint:
                self.i += 1
                self.qualified()
                while self.take(","):
                    self.qualified()
            elif word == "provides":
                raise Bad
            self.need(";")
        self.done()

    def annotation(self) -> None:
        self.need("@")
        self.qualified()
        if self.take("("):
            if not self.take(")"):
                while True:
                    if self.is_ident() and self.ahead() == "=":
                        self.i += 2
                    self.element_value()
                    if not self.take(","):
                        break
                self.need(")")

    def element_value(self) -> None:
        if self.tok == "@":
            self.annotation()
        elif self.take("{"):
            while not self.take("}"):
                self.element_value()
                if not self.take(","):
                    self.need("}")
                    break
        else:
            self.ternary()

    def modifiers(self) -> None:
        while True:
            if self.tok == "@" and self.ahead() != "interface":
                self.annotation()
            elif self.tok == "default" and self.ahead() in (":", "->"):
                return
            elif self.tok in _JAVA_MODIFIER:
                self.i += 1
            elif self.tok == "sealed" and self.declares(1):
                self.i += 1
            elif self.tok == "non" and self.ahead() == "-" and self.ahead(2) == "sealed":
                self.i += 3
            else:
                return

    def declares(self, k: int) -> bool:
        return self.ahead(k) in ("class", "interface", "abstract", "public", "static", "final", "strictfp", "private", "protected")

    def type_declaration(self) -> bool:
        t = self.tok
        if t == "class":
            self.i += 1
            self.ident()
            self.type_parameters()
            if self.take("extends"):
                self.type_()
            if self.take("implements"):
                self.types()
            if self.take("permits"):
                self.types()
            self.class_body()
        elif t == "interface" or (t == "@" and self.ahead() == "interface"):
            self.i += 1 + (t == "@")
            self.ident()
            self.type_parameters()
            if self.take("extends"):
                self.types()
            if self.take("permits"):
                self.types()
            self.class_body()
        elif t == "enum":
            self.i += 1
            self.ident()
            if self.take("implements"):
                self.types()
            self.need("{")
            while self.tok not in (";", "}"):
                while self.tok == "@":
                    self.annotation()
                self.ident()
                if self.tok == "(":
                    self.arguments()
                if self.tok == "{":
                    self.class_body()
                if not self.take(","):
                    break
            if self.take(";"):
                while self.tok != "}":
                    self.member()
            self.need("}")
        elif t == "record" and self.is_ident(1) and self.ahead(2) in ("(", "<"):
            self.i += 1
            self.ident()
            self.type_parameters()
            self.parameters()
            if self.take("implements"):
                self.types()
            self.class_body()
        else:
            return False
        return True

    def type_parameters(self) -> None:
        if self.take("<"):
            while True:
                while self.tok == "@":
                    self.annotation()
                self.ident()
                if self.take("extends"):
                    self.type_()
                    while self.take("&"):
                        self.type_()
                if not self.take(","):
                    break
            self.need(">")

    def types(self) -> None:
        self.type_()
        while self.take(","):
            self.type_()

    def type_(self, void: bool = False) -> None:
        while self.tok == "@":
            self.annotation()
        if void and self.take("void"):
            return
        if self.tok in _JAVA_PRIMITIVE:
            self.i += 1
        else:
            self.ident()
            self.type_arguments()
            while self.tok == "." and (self.is_ident(1) or self.ahead() == "@"):
                self.i += 1
                while self.tok == "@":
                    self.annotation()
                self.ident()
                self.type_arguments()
        self.dims()

    def dims(self) -> None:
        while self.tok == "@" or (self.tok == "[" and self.ahead() == "]"):
            if self.tok == "@":
                self.annotation()
            else:
                self.i += 2

    def type_arguments(self) -> None:
        if self.tok != "<":
            return
        self.i += 1
        if self.take(">"):
            return
        while True:
            while self.tok == "@":
                self.annotation()
            if self.take("?"):
                if self.take("extends", "super"):
                    self.type_()
            else:
                self.type_()
            if not self.take(","):
                break
        self.need(">")

    def class_body(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.member()

    def member(self) -> None:
        if self.take(";"):
            return
        if self.tok == "static" and self.ahead() == "{":
            self.i += 1
            return self.block()
        if self.tok == "{":
            return self.block()
        self.modifiers()
        if self.type_declaration():
            return None
        self.type_parameters()
        if self.is_ident() and self.ahead() == "(":  # a constructor
            self.i += 1
            self.parameters()
            self.throws()
            return self.block()
        if self.is_ident() and self.ahead() == "{":  # one of a record
            self.i += 1
            return self.block()
        self.type_(void=True)
        self.ident()
        if self.tok == "(":
            self.parameters()
            self.dims()
            self.throws()
            if self.take("default"):
                self.element_value()
            if not self.take(";"):
                self.block()
            return None
        self.dims()
        if self.take("="):
            self.variable_init()
        while self.take(","):
            self.ident()
            self.dims()
            if self.take("="):
                self.variable_init()
        self.need(";")

    def throws(self) -> None:
        if self.take("throws"):
            self.types()

    def parameters(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        while True:
            self.modifiers()
            self.type_()
            while self.tok == "@":
                self.annotation()
            self.take("...")
            if self.take("this"):
                pass
            else:
                if not self.take("_"):
                    self.ident()
                if self.take("."):
                    self.need("this")
            self.dims()
            if not self.take(","):
                break
        self.need(")")

    def variable_init(self) -> None:
        if self.tok == "{":
            self.array_init()
        else:
            self.expression()

    def array_init(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.variable_init()
            if not self.take(","):
                self.need("}")
                return

    # -- statements

    def block(self) -> None:
        self.need("{")
        t = self.t
        while t[self.i] != "}":
            self.statement(True)
        self.i += 1

    def parenthesised(self) -> None:
        start = self.i
        if self.tok != "(":
            raise Bad
        self.balanced()
        remembered("Java.expression", self.t[start + 1 : self.i - 1], self.whole_expression)

    def whole_expression(self, tokens: list[str]) -> None:
        own = Java(tokens)
        own.expression()
        own.done()

    def statement(self, local: bool = False) -> None:
        t = self.t[self.i]
        if t == "i" and self.t[self.i + 1] != ":":
            return remembered("Java.local" if local else "Java.plain", self.simple(), self.local if local else self.expression_statement)
        if t == "{":
            return self.block()
        if self.take(";"):
            return None
        if t == "if":
            self.i += 1
            self.parenthesised()
            self.statement()
            if self.take("else"):
                self.statement()
            return None
        if t == "while":
            self.i += 1
            self.parenthesised()
            return self.statement()
        if t == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.parenthesised()
            return self.need(";")
        if t == "for":
            self.i += 1
            start = self.i
            self.balanced()
            remembered("Java.for", self.t[start + 1 : self.i - 1], self.for_head)
            return self.statement()
        if t == "switch":
            self.switch()
            return None
        if t == "try":
            return self.try_()
        if t == "synchronized" and self.ahead() == "(":
            self.i += 1
            self.parenthesised()
            return self.block()
        if t in ("break", "continue"):
            self.i += 1
            if self.is_ident():
                self.i += 1
            return self.need(";")
        if t == "return":
            self.i += 1
            if not self.take(";"):
                self.to_semicolon()
            return None
        if t in ("throw",) or (t == "yield" and self.ahead() not in ("=", "(", ".", "[", "++", "--", "->", "::") and self.ahead() not in _JAVA_ASSIGN):
            self.i += 1
            return self.to_semicolon()
        if t == "assert":
            self.i += 1
            self.expression()
            if self.take(":"):
                self.expression()
            return self.need(";")
        if self.is_ident() and self.ahead() == ":":
            self.i += 2
            return self.statement()
        if t in ("else", "case", "default", "catch", "finally", "import", "package", "void", "extends", "throws") or not t:
            raise Bad
        if local:
            at = self.i
            self.modifiers()
            if self.type_declaration():
                return None
            self.i = at
        elif t in ("class", "interface", "enum"):
            raise Bad
        return remembered("Java.local" if local else "Java.plain", self.simple(), self.local if local else self.expression_statement)

    def to_semicolon(self) -> None:
        remembered("Java.expression", self.simple(), self.whole_expression)

    def local(self, tokens: list[str]) -> None:
        """A local variable's declaration or an expression statement."""
        try:
            return self.expression_statement(tokens)
        except Bad:
            own = Java(tokens)
            own.declaration()
            own.done()

    def declaration(self) -> None:
        self.modifiers()
        self.type_()
        while True:
            if not self.take("_"):
                self.ident()
            self.dims()
            if self.take("="):
                self.variable_init()
            if not self.take(","):
                return

    def expression_statement(self, tokens: list[str]) -> None:
        own = Java(tokens)
        if own.expression() not in ("assign", "call", "step", "new"):
            raise Bad
        own.done()

    def for_head(self, tokens: list[str]) -> None:
        own = Java(tokens)
        if ":" in tokens and ";" not in tokens or ("->" in tokens and ";" not in tokens):
            own.modifiers()
            own.type_()
            if not own.take("_"):
                own.ident()
            own.dims()
            own.need(":")
            own.expression()
            return own.done()
        if own.tok != ";":
            at = own.i
            try:
                own.statement_expressions()
                if own.tok != ";":
                    raise Bad
            except Bad:
                own.i = at
                own.declaration()
        own.need(";")
        if own.tok != ";":
            own.expression()
        own.need(";")
        if own.i < own.n:
            own.statement_expressions()
        own.done()

    def statement_expressions(self) -> None:
        while True:
            if self.expression() not in ("assign", "call", "step", "new"):
                raise Bad
            if not self.take(","):
                return

    def switch(self) -> None:
        self.need("switch")
        self.parenthesised()
        self.need("{")
        arrows = None
        while not self.take("}"):
            if self.take("default"):
                pass
            else:
                self.need("case")
                while True:
                    if self.take("default"):
                        pass
                    elif not self.attempt(self.pattern_label):
                        self.ternary()
                    if not self.take(","):
                        break
                if self.take("when"):
                    self.ternary()
            arrow = self.tok == "->"
            if arrows is not None and arrows != arrow:
                raise Bad
            arrows = arrow
            self.need("->", ":")
            if arrow:
                if self.tok == "{":
                    self.block()
                elif self.tok == "throw":
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                while self.tok not in ("case", "default", "}"):
                    self.statement(True)

    def pattern_label(self) -> None:
        self.pattern()
        if self.tok not in (",", ":", "->", "when"):
            raise Bad

    def pattern(self) -> None:
        self.modifiers()
        self.type_()
        if self.take("("):
            if not self.take(")"):
                self.pattern()
                while self.take(","):
                    self.pattern()
                self.need(")")
            if self.is_ident() and self.tok != "when":
                self.i += 1
        elif not self.take("_"):
            if self.tok == "when" and self.ahead() not in ("when", "->", ":", ",", ")"):
                raise Bad
            self.ident()

    def try_(self) -> None:
        self.need("try")
        resources = False
        if self.take("("):
            resources = True
            while True:
                at = self.i
                if self.attempt(self.declaration) and self.tok in (";", ")") and "=" in self.t[at : self.i]:
                    pass
                else:
                    self.i = at
                    self.expression()
                if not self.take(";") or self.tok == ")":
                    break
            self.need(")")
        self.block()
        caught = False
        while self.take("catch"):
            self.need("(")
            self.modifiers()
            self.type_()
            while self.take("|"):
                self.type_()
            if not self.take("_"):
                self.ident()
            self.need(")")
            self.block()
            caught = True
        if self.take("finally"):
            self.block()
        elif not caught and not resources:
            raise Bad

    # -- expressions; each rule gives the kind of what it read

    def expression(self) -> str:
        if self.lambda_ahead():
            return self.lambda_()
        kind = self.ternary()
        if self.tok in _JAVA_ASSIGN or (self.tok == ">" and self.ahead() == ">" and self.ahead(2) in (">=", ">")) or (self.tok == ">" and self.ahead() == ">="):
            if self.tok == ">":
                while self.tok == ">":
                    self.i += 1
                self.need(">=")
            else:
                self.i += 1
            if kind not in ("name", "field", "index"):
                raise Bad
            self.expression()
            return "assign"
        return kind

    def lambda_ahead(self) -> bool:
        if (self.is_ident() or self.tok == "_") and self.ahead() == "->":
            return True
        if self.tok != "(":
            return False
        at = self.i
        try:
            self.balanced()
            return self.tok == "->"
        except Bad:
            return False
        finally:
            self.i = at

    def lambda_(self) -> str:
        if self.tok == "(":
            at = self.i
            self.i += 1
            plain = True
            if not self.take(")"):
                while True:
                    if not (self.is_ident() or self.tok == "_"):
                        plain = False
                        break
                    self.i += 1
                    if not self.take(","):
                        break
                if plain:
                    plain = self.take(")")
            if not plain:
                self.i = at
                self.parameters()
        else:
            self.i += 1
        self.need("->")
        if self.tok == "{":
            self.block()
        else:
            self.expression()
        return "lambda"

    def ternary(self) -> str:
        kind = self.binary(1)
        if self.take("?"):
            self.expression()
            self.need(":")
            if self.lambda_ahead():
                self.lambda_()
            else:
                self.ternary()
            return "value"
        return kind

    def binary(self, level: int) -> str:
        kind = self.unary()
        while True:
            op = self.tok
            own = _JAVA_BINARY.get(op, 0)
            width = 1
            if op == ">" and self.ahead() == ">":  # shifts come as single signs
                width = 3 if self.ahead(2) == ">" else 2
                if self.ahead(width) == ">=" or self.ahead(width - 1) == ">=":
                    return kind
                own = 8
            elif op == ">" and self.ahead() == ">=":
                return kind
            if own < level or not own or self.i >= self.n:
                return kind
            self.i += width
            if op == "instanceof":
                at = self.i
                if not self.attempt(self.pattern):
                    self.i = at
                    self.modifiers()
                    self.type_()
            else:
                self.binary(own + 1)
            kind = "value"

    def unary(self) -> str:
        t = self.tok
        if t in ("++", "--"):
            self.i += 1
            if self.unary() not in ("name", "field", "index"):
                raise Bad
            return "step"
        if t in ("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return "value"
        if t == "(":
            at = self.i
            if self.attempt(self.cast):
                return "value"
            self.i = at
        return self.postfix()

    def cast(self) -> None:
        self.need("(")
        primitive = self.tok in _JAVA_PRIMITIVE
        self.type_()
        array = self.t[self.i - 1] == "]"
        while self.take("&"):
            self.type_()
        self.need(")")
        if self.lambda_ahead():
            self.lambda_()
            return
        if not (primitive and not array) and self.tok in ("+", "-", "++", "--"):
            raise Bad
        self.unary()

    def arguments(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        while True:
            self.expression()
            if not self.take(","):
                break
        self.need(")")

    def postfix(self) -> str:
        kind = self.primary()
        while True:
            if self.tok == ".":
                self.i += 1
                if self.take("new"):
                    self.creator()
                    kind = "new"
                    continue
                if self.tok == "<":
                    self.type_arguments()
                if self.take("class", "this"):
                    kind = "value"
                elif self.take("super"):
                    if self.tok == "(":
                        self.arguments()
                        kind = "call"
                    else:
                        kind = "super"
                    continue
                else:
                    self.ident()
                    kind = "field"
                    if self.tok == "(":
                        self.arguments()
                        kind = "call"
            elif self.tok == "[":
                if self.ahead() == "]":
                    self.dims()
                    if self.tok not in (".", "::"):
                        raise Bad
                    continue
                self.i += 1
                self.expression()
                self.need("]")
                kind = "index"
            elif self.tok == "::":
                self.i += 1
                if self.tok == "<":
                    self.type_arguments()
                if not self.take("new"):
                    self.ident()
                kind = "value"
            elif self.tok in ("++", "--") and kind in ("name", "field", "index"):
                self.i += 1
                kind = "step"
            elif self.tok == "<" and kind in ("name", "field"):
                at = self.i
                if self.attempt(self.type_arguments):
                    self.attempt(self.dims)
                    if self.tok == "::" or (self.tok == "." and self.is_ident(1)):
                        continue
                self.i = at
                return kind
            else:
                return kind

    def primary(self) -> str:
        t = self.tok
        if t in ("0", "s", "c", "true", "false", "null"):
            self.i += 1
            return "value"
        if t == "(":
            self.i += 1
            kind = self.expression()
            self.need(")")
            return kind if kind in ("name", "field", "index") else "value"
        if t == "this":
            self.i += 1
            if self.tok == "(":
                self.arguments()
                return "call"
            return "value"
        if t == "super":
            self.i += 1
            if self.tok == "(":
                self.arguments()
                return "call"
            if self.tok not in (".", "::"):
                raise Bad
            return "super"
        if t == "new":
            self.i += 1
            self.creator()
            return "new"
        if t == "switch":
            self.switch()
            return "value"
        if t in _JAVA_PRIMITIVE or t == "void":
            self.i += 1
            self.dims()
            if self.tok not in (".", "::") or (self.tok == "." and self.ahead() != "class"):
                raise Bad
            return "value"
        self.ident()
        if self.tok == "(":
            self.arguments()
            return "call"
        return "name"

    def creator(self) -> None:
        while self.tok == "@":
            self.annotation()
        if self.tok == "<":
            self.type_arguments()
        if self.tok in _JAVA_PRIMITIVE:
            self.i += 1
        else:
            self.ident()
            self.type_arguments()
            while self.take("."):
                self.ident()
                self.type_arguments()
        if self.tok == "(":
            self.arguments()
            if self.tok == "{":
                self.class_body()
            return
        if self.tok != "[":
            raise Bad
        if self.ahead() == "]":
            self.dims()
            return self.array_init()
        while self.tok == "[" and self.ahead() != "]":
            self.i += 1
            self.expression()
            self.need("]")
        self.dims()


def _java(tokens: list[tuple[str, str]]) -> None:
    reader = Java(_classes(tokens, _JAVA_WORDS | _JAVA_SOFT))
    words = [t for _, t in tokens]
    if "module" in words:
        at = words.index("module")
        if tokens[at][0] == "i" and tokens[at + 1 : at + 2] and tokens[at + 1][0] == "i" and not {"class", "interface", "enum", "record"} & set(words[:at]) and "(" not in words[at : at + 3]:
            return reader.module(tokens)
    reader.unit()


# ---------------------------------------------------------------- Go

#: Key words of Go.
_GO_WORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GO_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
_GO_ASSIGN = set("= += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_GO_ENDS = {"i", "0", "s", "c", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


class Go(Reader):
    def __init__(self, tokens: list[str]):
        super().__init__(tokens)
        self.level = 0  # below 0 in a head of if, for or switch, where a brace begins the body

    def end(self) -> None:
        if not self.take(";") and self.tok not in (")", "}", ""):
            raise Bad

    def unit(self) -> None:
        self.need("package")
        self.need("i")
        self.need(";")
        while self.take("import"):
            self.group(self.import_)
            self.end()
        while self.i < self.n:
            if self.tok == "func":
                self.function()
            elif self.tok in ("const", "var", "type"):
                self.declaration()
            else:
                raise Bad
            if self.i < self.n:
                self.need(";")

    def group(self, rule) -> None:
        if self.take("("):
            while not self.take(")"):
                rule()
                self.end()
        else:
            rule()

    def import_(self) -> None:
        self.take("i", ".")
        self.need("s")

    def declaration(self) -> None:
        word = self.tok
        self.i += 1
        self.group({"const": self.const, "var": self.var, "type": self.type_spec}[word])

    def names(self) -> None:
        self.need("i")
        while self.take(","):
            self.need("i")

    def const(self) -> None:
        self.names()
        if self.tok not in ("=", ";", ")"):
            self.type_()
        if self.take("="):
            self.expressions()

    def var(self) -> None:
        self.names()
        if self.tok != "=":
            self.type_()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.need("i")
        if self.tok == "[":
            at = self.i
            if not self.attempt(self.type_parameters):
                self.i = at
        self.take("=")
        self.type_()

    def type_parameters(self) -> None:
        self.need("[")
        while True:
            self.names()
            self.constraint()
            if not self.take(",") or self.tok == "]":
                break
        self.need("]")

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type_()
            if not self.take("|"):
                return

    def function(self) -> None:
        self.need("func")
        if self.tok == "(":
            self.parameters()
        self.need("i")
        if self.tok == "[":
            self.type_parameters()
        self.signature()
        if self.tok == "{":
            self.block()

    def signature(self) -> None:
        self.parameters()
        if self.tok == "(":
            self.parameters()
        elif self.tok in ("i", "*", "[", "map", "chan", "<-", "func", "struct", "interface"):
            self.type_()

    def parameters(self) -> None:
        """All with names or all without."""
        self.need("(")
        at, level = self.i, self.level
        self.level = 0
        try:
            if self.attempt(self.named_parameters):
                return
            self.i = at
            while not self.take(")"):
                self.take("...")
                self.type_()
                if not self.take(","):
                    self.need(")")
                    return
        finally:
            self.level = level

    def named_parameters(self) -> None:
        while not self.take(")"):
            self.names()
            self.take("...")
            self.type_()
            if not self.take(","):
                self.need(")")
                return

    def type_(self) -> None:
        t = self.tok
        if t == "i":
            self.i += 1
            if self.tok == "." and self.ahead() == "i":
                self.i += 2
            if self.tok == "[" and self.ahead() != "]":
                at = self.i
                if not self.attempt(self.type_list):
                    self.i = at
        elif t == "*":
            self.i += 1
            self.type_()
        elif t == "(":
            self.i += 1
            self.type_()
            self.need(")")
        elif t == "[":
            self.i += 1
            if not self.take("]"):
                if not self.take("..."):
                    level, self.level = self.level, 0
                    self.expression()
                    self.level = level
                self.need("]")
            self.type_()
        elif t == "map":
            self.i += 1
            self.need("[")
            self.type_()
            self.need("]")
            self.type_()
        elif t == "chan":
            self.i += 1
            self.take("<-")
            self.type_()
        elif t == "<-":
            self.i += 1
            self.need("chan")
            self.type_()
        elif t == "func":
            self.i += 1
            self.signature()
        elif t == "struct":
            self.i += 1
            self.need("{")
            while not self.take("}"):
                self.field()
                self.end()
        elif t == "interface":
            self.i += 1
            self.need("{")
            while not self.take("}"):
                if self.tok == "i" and self.ahead() == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.end()
        else:
            raise Bad

    def type_list(self) -> None:
        self.need("[")
        self.type_()
        while self.take(","):
            if self.tok == "]":
                break
            self.type_()
        self.need("]")

    def field(self) -> None:
        if self.tok == "*" or (self.tok == "i" and self.ahead() in (";", "}", ".", "s")):
            self.take("*")
            self.type_()
        else:
            self.names()
            self.type_()
        self.take("s")

    # -- statements

    def block(self) -> None:
        level, self.level = self.level, 0
        self.need("{")
        while not self.take("}"):
            self.statement()
            self.end()
        self.level = level

    def statement(self) -> None:
        t = self.t[self.i]
        if t == "i" and self.t[self.i + 1] != ":":
            return self.quick()
        if t in (";", "}"):
            return None
        if t == "{":
            return self.block()
        if t in ("const", "var", "type"):
            return self.declaration()
        if t == "if":
            return self.if_()
        if t == "for":
            return self.for_()
        if t == "switch":
            return self.switch()
        if t == "select":
            self.i += 1
            self.need("{")
            while not self.take("}"):
                if not self.take("default"):
                    self.need("case")
                    self.simple_statement()
                self.need(":")
                self.body()
            return None
        if t == "return":
            self.i += 1
            if self.tok not in (";", "}"):
                self.expressions()
            return None
        if t in ("break", "continue"):
            self.i += 1
            self.take("i")
            return None
        if t == "goto":
            self.i += 1
            return self.need("i")
        if t == "fallthrough":
            self.i += 1
            return None
        if t in ("go", "defer"):
            self.i += 1
            if self.expression() != "call":
                raise Bad
            return None
        if t == "i" and self.ahead() == ":":
            self.i += 2
            if self.tok == "}":
                return None
            return self.statement()
        if t == "func" and self.ahead() == "i":
            raise Bad
        return self.quick()

    def quick(self) -> None:
        """A simple statement without braces is checked once for each sequence of classes."""
        at = self.i
        depth = 0
        while True:
            t = self.t[at]
            if t in ("(", "["):
                depth += 1
            elif t in (")", "]"):
                depth -= 1
            if t == "{" or t == "func" or depth < 0 or at >= self.n or (t == "}" and not depth):
                break
            if t == ";" and not depth:
                tokens = self.t[self.i : at]
                remembered("Go.simple", tokens, self.whole_simple)
                self.i = at
                return
            at += 1
        self.simple_statement()

    def whole_simple(self, tokens: list[str]) -> None:
        own = Go(tokens)
        own.simple_statement()
        own.done()

    def body(self) -> None:
        while self.tok not in ("case", "default", "}"):
            self.statement()
            self.end()

    def simple_statement(self, ranged: bool = False) -> str:
        if ranged and self.take("range"):
            self.expression()
            return "range"
        start = self.i
        kinds = [self.expression()]
        while self.take(","):
            kinds.append(self.expression())
        t = self.tok
        if t == ":=":
            if any(x != "i" and x != "," for x in self.t[start : self.i]):
                raise Bad
            self.i += 1
            if ranged and self.take("range"):
                self.expression()
                return "range"
            if self.tok == "i" and False:
                pass
            self.expressions(types=True)
            return "define"
        if t in _GO_ASSIGN:
            if t != "=" and len(kinds) > 1:
                raise Bad
            self.i += 1
            if ranged and t == "=" and self.take("range"):
                self.expression()
                return "range"
            self.expressions()
            return "assign"
        if len(kinds) > 1:
            raise Bad
        if self.take("++", "--"):
            return "step"
        if self.take("<-"):
            self.expression()
            return "send"
        return "expression"

    def header(self) -> int:
        level, self.level = self.level, -1
        return level

    def if_(self) -> None:
        self.need("if")
        level = self.header()
        if self.tok == "{":
            raise Bad
        kind = "" if self.tok == ";" else self.simple_statement()
        if self.take(";"):
            if self.tok == "{":
                raise Bad
            kind = self.simple_statement()
        if kind != "expression":
            raise Bad
        self.level = level
        self.block()
        if self.take("else"):
            if self.tok == "if":
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.need("for")
        level = self.header()
        if self.tok != "{":
            kind = "" if self.tok == ";" else self.simple_statement(ranged=True)
            if kind == "range":
                pass
            elif self.take(";"):
                if self.tok != ";":
                    if self.tok == "{":
                        raise Bad
                    if self.simple_statement() != "expression":
                        raise Bad
                self.need(";")
                if self.tok != "{" and self.simple_statement() == "define":
                    raise Bad
            elif kind != "expression":
                raise Bad
        self.level = level
        self.block()

    def switch(self) -> None:
        self.need("switch")
        level = self.header()
        if self.tok != "{":
            if self.tok != ";":
                self.simple_statement()
            if self.take(";") and self.tok != "{":
                self.simple_statement()
        self.level = level
        self.need("{")
        while not self.take("}"):
            if not self.take("default"):
                self.need("case")
                self.expressions(types=True)
            self.need(":")
            level2, self.level = self.level, 0
            self.body()
            self.level = level2

    # -- expressions

    def expressions(self, types: bool = False) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self, level: int = 1) -> str:
        kind = self.unary()
        while True:
            own = _GO_BINARY.get(self.tok, 0)
            if own < level or not own or self.i >= self.n:
                return kind
            self.i += 1
            self.expression(own + 1)
            kind = "value"

    def unary(self) -> str:
        if self.tok in ("+", "-", "!", "^", "&", "*", "~"):
            self.i += 1
            self.unary()
            return "value"
        if self.tok == "<-":
            if self.ahead() == "chan":
                self.type_()
                return self.suffixes("type")
            self.i += 1
            self.unary()
            return "value"
        return self.primary()

    def primary(self) -> str:
        t = self.tok
        if t in ("0", "s", "c"):
            self.i += 1
            return self.suffixes("value")
        if t == "i":
            self.i += 1
            return self.suffixes("name")
        if t == "(":
            level, self.level = self.level, 0
            self.i += 1
            at = self.i
            if not (self.attempt(self.expression) and self.tok == ")"):
                self.i = at
                self.type_()
            self.need(")")
            self.level = level
            return self.suffixes("value")
        if t == "func":
            self.i += 1
            self.signature()
            if self.tok == "{":
                level, self.level = self.level, 0
                self.block()
                self.level = level
                return self.suffixes("value")
            return self.suffixes("type")
        if t in ("[", "map", "chan", "struct", "interface"):
            self.type_()
            if self.tok == "{" and t in ("[", "map", "struct"):
                self.literal()
                return self.suffixes("value")
            return self.suffixes("type")
        raise Bad

    def suffixes(self, kind: str) -> str:
        while True:
            t = self.tok
            if t == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type_()
                    self.need(")")
                    kind = "value"
                else:
                    self.need("i")
                    kind = "name" if kind in ("name", "value") else kind
            elif t == "[":
                level, self.level = self.level, 0
                self.i += 1
                self.index()
                self.level = level
                kind = "name" if kind == "name" else "value"
            elif t == "(":
                level, self.level = self.level, 0
                self.i += 1
                while not self.take(")"):
                    at = self.i
                    if not (self.attempt(self.expression) and self.tok in (",", ")", "...")):
                        self.i = at
                        self.type_()
                    self.take("...")
                    if not self.take(","):
                        self.need(")")
                        break
                self.level = level
                kind = "call"
            elif t == "{" and kind in ("name", "type") and self.level >= 0:
                self.literal()
                kind = "value"
            else:
                return kind

    def index(self) -> None:
        if self.tok == "]":
            raise Bad
        colons = 0
        if self.tok != ":":
            at = self.i
            if not (self.attempt(self.expression) and self.tok in (":", "]", ",")):
                self.i = at
                self.type_()
            while self.take(","):
                if self.tok == "]":
                    break
                at = self.i
                if not (self.attempt(self.expression) and self.tok in (",", "]")):
                    self.i = at
                    self.type_()
        while self.take(":"):
            colons += 1
            if self.tok not in (":", "]"):
                self.expression()
        if colons > 2:
            raise Bad
        self.need("]")

    def literal(self) -> None:
        level, self.level = self.level, 0
        self.need("{")
        while not self.take("}"):
            self.element()
            if self.take(":"):
                self.element()
            if not self.take(","):
                self.need("}")
                break
        self.level = level

    def element(self) -> None:
        if self.tok == "{":
            self.literal()
        else:
            self.expression()


def _go(tokens: list[tuple[str, str]]) -> None:
    out: list[str] = []
    last = ""
    for kind, t in tokens:
        if kind == "l":
            if last not in _GO_ENDS:
                continue
            last = ";"
        elif kind == "o":
            last = t
        elif kind == "i":
            last = t if t in _GO_WORDS else "i"
        elif kind == "x" or (kind == "n" and t[0] == "0" and _NOT_OCTAL(t)):
            raise Bad
        else:
            last = _CLASS[kind]
        out.append(last)
    if last in _GO_ENDS:
        out.append(";")
    Go(out).unit()


# ---------------------------------------------------------------- files


def decoded(lang: str, content: bytes) -> str | None:
    """The text of a file, or None if its bytes are no text of the language. Bytes of another encoding are fine in C and C++."""
    if lang in ("c", "cpp"):
        return content.removeprefix(b"\xef\xbb\xbf").decode("utf-8", "surrogateescape")
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return text.removeprefix("﻿") if lang in ("go", "json") else text


def accepts_tokens(lang: str, tokens: list[tuple[str, str]], state: str = "code") -> bool:
    """Whether the tokens of a file, and the lexer state at its end, are a whole file of lang: c, cpp, java or go."""
    if state != "code":
        return False
    try:
        try:
            _file(lang, tokens)
        except RecursionError:
            with _deeper(len(tokens)):
                _file(lang, tokens)
    except (Bad, IndexError):
        return False
    return True


def _file(lang: str, tokens: list[tuple[str, str]]) -> None:
    if lang == "java":
        _java(tokens)
    elif lang == "go":
        _go(tokens)
    else:
        _c_family(lang, tokens)


@contextlib.contextmanager
def _deeper(n: int) -> Iterator[None]:
    """Room for nesting as deep as n tokens can be. Calls between functions of Python take heap and no stack, and only as they are made."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, min(4000 + 200 * n, (1 << 31) - 1)))
    try:
        yield
    finally:
        sys.setrecursionlimit(limit)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def accepts(lang: str, content: bytes) -> bool:
    """Whether the grammar of lang accepts content as a whole file."""
    if lang == "python":
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(content)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return False
        return True
    text = decoded(lang, content)
    if text is None:
        return False
    if lang == "json":
        try:
            try:
                json.loads(text, parse_constant=_no_constant)
            except RecursionError:  # the scanner in C has a depth of its own; the one in Python is the same otherwise
                reader = json.JSONDecoder(parse_constant=_no_constant)
                reader.scan_once = json.scanner.py_make_scanner(reader)
                with _deeper(len(text)):
                    reader.decode(text)
        except ValueError:
            return False
        return True
    return accepts_tokens(lang, *lex(lang, text))
