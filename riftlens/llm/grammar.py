"""Grammars over token classes: productions as regular expressions on flat windows of tokens.

A window is what stands between a pair of brackets.  Windows are reduced innermost first: each is held against the
productions that a bracket of its kind can have in the language (its *roles*, such as arguments, block or class body) and
replaced by one symbol that names the roles it fits.  What is left at the end must be a whole file.  As every window is
flat, its productions are regular, and as windows repeat, each distinct one is matched once.

From the same productions :func:`permissible` derives which token classes may follow each other anywhere.

Notation: words of two letters and more are keywords, single characters token classes, ``<name>`` a macro, ``<P.x>``,
``<K.x>`` and ``<C.x>`` a reduced window in round, square or curly brackets with role x; the rest is regular expression.
"""

from __future__ import annotations

import re
from functools import lru_cache

import regex

from riftlens.llm.lexing import INDENT, INDENTS, KEYWORDS, keyword

BASE = {"P": 0xF000, "K": 0xF200, "C": 0xF400}
#: How many symbols of each kind there may be: two to the number of its roles.
SYMBOLS = {"P": 0x200, "K": 0x200, "C": 0x400}
OPEN = {"P": "(", "K": "[", "C": "{"}
CLOSE = {"P": ")", "K": "]", "C": "}"}
KIND = {"(": "P", "[": "K", "{": "C"}
FAILED = chr(0xF7FF)
#: The ends of a window, where its pairs of classes are looked at.
BEGIN, END = "\x02", "\x03"
_INNER = re.compile(r"\([^()\[\]{}]*\)|\[[^()\[\]{}]*\]|\{[^()\[\]{}]*\}")

ANY = r"[\s\S]*"

JSON = {
    "value": r"(?:s|n|true|false|null|<C.object>|<K.array>)",
    "roles": {"C": {"object": r"(?:s:<value>(?:,s:<value>)*)?"}, "K": {"array": r"(?:<value>(?:,<value>)*)?"}, "P": {}},
    "top": r"<value>",
}

GO = {
    "name": r"i(?:\.i)?",
    "tpre": r"(?:\*|<K.dim>|map<K.dim>|chanR?|Rchan|T)*",
    "plain": r"<tpre>(?:<name><K.dim>?|struct<C.struct>|interface<C.iface>|<P.params>|func<P.params>(?:<P.params>|<tpre><name><K.dim>?)?)",
    "type": r"<tpre>(?:<name><K.dim>?|struct<C.struct>|interface<C.iface>|<P.params>|func<P.params>(?:<P.params>|<plain>)?)",
    "result": r"(?:<P.params>|<type>)",
    "pre": r"(?:[P!*&RB])*",
    "prim": r"(?:[ins]|<P.args>|func<P.params><result>?<C.block>|<tpre>(?:<name><K.dim>?|struct<C.struct>|interface<C.iface>)(?:<C.lit>|<P.args>)|<type>)",
    "post": r"(?:\.i|\.<P.type>|<P.args>|<K.index>|<C.lit>)*",
    "operand": r"<pre><prim><post>",
    "bin": r"(?:[BYOP*&|<]|>{1,2})",
    "expr": r"<operand>(?:<bin><operand>)*",
    "list": r"<expr>(?:,<expr>)*",
    "simple": r"(?:<list>(?:[=AW](?:range)?<list>|U|R<expr>)?)",
    "names": r"i(?:,i)*",
    "varspec": r"<names>(?:<type>?=<list>|<type>)",
    "constspec": r"<names>(?:<type>?=<list>)?",
    "typespec": r"i(?:<K.dim>)?=?<type>(?:\|<type>)*",
    "decl": r"(?:var(?:<varspec>|<P.vars>)|const(?:<constspec>|<P.consts>)|type(?:<typespec>|<P.types>))",
    "if": r"if(?:<simple>?;)?<expr><C.block>(?:elseif(?:<simple>?;)?<expr><C.block>)*(?:else<C.block>)?",
    "for": r"for(?:<simple>?;<expr>?;<simple>?|(?:<list>[=W])?range<expr>|<expr>)?<C.block>",
    "switch": r"switch(?:<simple>?;)?(?:<simple>)?<C.switch>|select<C.switch>",
    "stmt": r"(?:(?:i:)*(?:<decl>|<if>|<for>|<switch>|return<list>?|(?:go|defer)<expr>|breaki?|continuei?|gotoi|fallthrough|<C.block>|<simple>)?)",
    "seq": r"<stmt>(?:;<stmt>)*",
    "roles": {
        "C": {
            "block": r"<seq>", "lit": r"(?:(?:(?:<expr>|<C.lit>)(?::(?:<expr>|<C.lit>))?)(?:,(?:<expr>|<C.lit>)(?::(?:<expr>|<C.lit>))?)*,?)?",
            "struct": r"(?:(?:<names><type>|\*?<name><K.dim>?)s?;|;)*(?:(?:<names><type>|\*?<name><K.dim>?)s?)?", "iface": r"(?:(?:i<P.params><result>?|!?<type>(?:\|!?<type>)*);|;)*(?:i<P.params><result>?|!?<type>(?:\|!?<type>)*)?",
            "switch": r"(?:(?:case(?:<list>|<type>(?:,<type>)*|<simple>)|default):<seq>)*",
        },
        "P": {
            "params": r"(?:(?:i?T?<type>)(?:,i?T?<type>)*,?)?", "args": r"(?:(?:<expr>|<type>)(?:,(?:<expr>|<type>))*T?,?)?", "type": r"<type>|type",
            "vars": r"(?:(?:<varspec>);|;)*(?:<varspec>)?", "consts": r"(?:(?:<constspec>);|;)*(?:<constspec>)?", "types": r"(?:(?:<typespec>);|;)*(?:<typespec>)?", "imports": r"(?:(?:[i.]?s)?;)*(?:[i.]?s)?",
        },
        "K": {"dim": r"(?:<expr>|T|<type>(?:,<type>)*|(?:<names>!?<type>(?:\|!?<type>)*)(?:,<names>!?<type>)*,?)?", "index": r"<expr>?(?::<expr>?){0,2}|<type>(?:,<type>)*"},
    },
    "top": r";*packagei;+(?:import(?:[i.]?s|<P.imports>)(?:;+|\Z))*(?:(?:<decl>|func<P.params>?i<K.dim>?<P.params><result>?<C.block>?)(?:;+|\Z))*",
}

JAVA = {
    "ann": r"@i(?:\.i)*<P.args>?",
    "mods": r"(?:<ann>|public|private|protected|static|final|abstract|native|synchronized|transient|volatile|strictfp|default)*",
    "word": r"(?:boolean|byte|char|short|int|long|float|double|void)",
    "targs": r"<(?:[i?.,<>&]|extends|super|<word>|<K.empty>|<ann>)*>",
    "type": r"(?:<ann>)*(?:<word>|i<targs>?(?:\.i<targs>?)*)<K.empty>*",
    "head": r"(?:i|<P.lambda>)R",
    "pre": r"(?:[P!U]|<P.cast>|<head>)*",
    "new": r"new(?:<type>(?:<P.args><C.class>?|<C.array>)|(?:<word>|i<targs>?(?:\.i<targs>?)*)<K.index>+<K.empty>*)",
    "prim": r"(?:[nsi]|true|false|null|this|super|<word><K.empty>*\.class|<type>Dnew|<P.paren>|<new>|switch<P.paren><C.switch>)",
    "post": r"(?:\.(?:<targs>)?(?:i|this|class|super|<new>)|<P.args>|<K.index>|U|D(?:<targs>)?(?:i|new)|<K.empty>+(?:\.class|Dnew)|<targs>D(?:i|new))*",
    "operand": r"(?:<pre><prim><post>|<pre><head><C.block>)",
    "bin": r"(?:[BYOP*&|<]|>{1,3})",
    "b1": r"<operand>(?:<bin><operand>|instanceof(?:final)?<type>(?:i|<P.args>)?)*",
    "tern": r"<b1>(?:\?<b1>(?:\?<b1>:<b1>)?:<b1>)*",
    "expr": r"(?:<tern>[=A])*<tern>",
    "init": r"(?:<expr>|<C.array>)",
    "locals": r"(?:final|<ann>)*<type>i<K.empty>*(?:=<init>)?(?:,i<K.empty>*(?:=<init>)?)*",
    "exprstmt": r"(?:U<prim><post>|<prim><post>(?:U|<P.args>)|<prim><post>[=A]<expr>|<new><post>|<prim><post>)",
    "effect": r"(?:U+<prim><post>|(?:<P.cast>)*<prim>(?:<post>(?:U|<P.args>)|<post>[=A]<expr>)|(?:<P.args>)|(?:this|super)<P.args>|<new><post>)",
    "heads": r"(?:i:|for<P.for>|while<P.paren>|synchronized<P.paren>)*",
    "core": r"(?:<C.block>|;|<effect>;|return<expr>?;|throw<expr>;|breaki?;|continuei?;|assert<expr>(?::<expr>)?;|i<expr>;|dobody|<try>|switch<P.paren><C.switch>)",
    "try": r"try<P.res>?<C.block>(?:catch<P.catch><C.block>)*(?:finally<C.block>)?",
    "core1": r"(?:<C.block>|;|<effect>;|return<expr>?;|throw<expr>;|breaki?;|continuei?;|assert<expr>(?::<expr>)?;|<try>|switch<P.paren><C.switch>|do(?:<C.block>|<effect>;)while<P.paren>;)",
    "body": r"<heads>(?:<core1>|if<P.paren><heads><core1>(?:else<heads><core1>)?)",
    "if": r"if<P.paren><body>(?:elseif<P.paren><body>)*(?:else<body>)?",
    "stmt": r"(?:<heads>(?:<if>|<core1>)|<locals>;|i<expr>;|<typedecl>)",
    "throws": r"(?:throws<type>(?:,<type>)*)?",
    "typedecl": r"<mods>(?:(?:class|interface|enum|@interface)i<targs>?|ii<targs>?<P.params>)(?:extends<type>(?:,<type>)*)?(?:implements<type>(?:,<type>)*)?(?:i<type>(?:,<type>)*)?<C.class>",
    "member": r"(?:;|<mods><targs>?(?:<type>)?i<P.params><K.empty>*<throws>(?:<C.block>|default<init>;|;)|<mods><type>i<K.empty>*(?:=<init>)?(?:,i<K.empty>*(?:=<init>)?)*;|(?:static)?<C.block>|i<C.block>|<typedecl>)",
    "constant": r"(?:<ann>)*i<P.args>?<C.class>?",
    "label": r"(?:case(?:<tern>|<type>i?|default)(?:,(?:<tern>|default))*(?:i<expr>)?|default)",
    "roles": {
        "C": {
            "block": r"<stmt>*", "class": r"(?:<constant>(?:,<constant>)*,?(?:;<member>*)?|<member>*)", "array": r"(?:<init>(?:,<init>)*,?)?",
            "switch": r"(?:<label>:<stmt>*)*|(?:<label>R(?:<C.block>|<expr>;|throw<expr>;))*",
        },
        "P": {
            "args": r"(?:(?:i=)?(?:<expr>|<C.array>|<ann>)(?:,(?:i=)?(?:<expr>|<C.array>|<ann>))*)?", "paren": r"<expr>", "cast": r"<type>(?:&<type>)*", "lambda": r"(?:(?:final)?<type>?T?i(?:,(?:final)?<type>?T?i)*)?",
            "params": r"(?:(?:final|<ann>)*<type>T?(?:i|this)<K.empty>*(?:,(?:final|<ann>)*<type>T?i<K.empty>*)*)?", "for": r"(?:<locals>|<expr>(?:,<expr>)*)?;<expr>?;(?:<expr>(?:,<expr>)*)?|(?:final|<ann>)*<type>i:<expr>",
            "catch": r"(?:final|<ann>)*<type>(?:\|<type>)*i", "res": r"(?:(?:<locals>|<expr>);)*(?:<locals>|<expr>);?",
        },
        "K": {"empty": r"", "index": r"<expr>"},
    },
    "top": r"(?:(?:<ann>)*packagei(?:\.i)*;)?(?:;|import(?:static)?i(?:\.i)*(?:\.\*)?;)*(?:;|<typedecl>)*",
}
del JAVA["core"], JAVA["exprstmt"]

RUST = {
    "attr": r"\#!?<K.any>",
    "vis": r"(?:pub<P.any>?)?",
    "seg": r"(?:i|self|Self|super|crate)",
    "targs": r"<(?:[iLn,D&*=:PTR?<>!s.]|mut|const|dyn|impl|self|Self|super|crate|for|as|fn|unsafe|true|false|where|<P.any>|<K.any>|<C.block>)*>",
    "path": r"D?(?:<targs>D)?<seg><targs>?(?:D(?:<seg><targs>?|<targs>))*",
    "tpre": r"(?:[&Y]L?(?:mut)?|\*(?:const|mut)|dyn|impl|for<targs>|\?)*",
    "bound": r"(?:L|\??<tpre>(?:<path>|<P.types>)(?:<P.types>)?(?:R<tpre>(?:<path>|<P.types>|<K.array>))?)",
    "type": r"<tpre>(?:<path>(?:<P.types>(?:R<tpre>(?:<path>|<P.types>|<K.array>))?)?|<P.types>|<K.array>|!|(?:unsafe)?(?:externs?)?fn<P.types>(?:R<tpre>(?:<path>|<P.types>))?)(?:P<bound>)*",
    "pat1": r"(?:[&Y]|mut|ref|L)*(?:P?n|s|true|false|<path>(?:<P.pats>|<C.pats>|!<P.any>)?|<P.pats>|<K.pats>|T)(?:@(?:P?n|s|<path>(?:<P.pats>)?|<P.pats>))?(?:T(?:P?n|s|<path>)?)?",
    "pat": r"\|?<pat1>(?:\|<pat1>)*",
    "closure": r"(?:async)?(?:move)?(?:O|\|(?:<pat1>(?::<type>)?(?:,<pat1>(?::<type>)?)*,?)?\|)",
    "pre": r"(?:[P!*]|[&Y](?:mut)?|<closure>(?:R<type>)?|T|return|break(?:L)?|L:)*",
    "macro": r"<path>!i?(?:<P.any>|<K.any>|<C.any>)",
    "simple": r"(?:[ns]|true|false|<macro>|<path>(?:<C.struct>)?|<P.tuple>|<K.array>|<C.block>|(?:unsafe|async|asyncmove|const)<C.block>|loop<C.block>|continueL?|break|return)",
    "post": r"(?:\.(?:i|n|await)(?:D<targs>)?|<P.args>|<K.array>|\?)*",
    "bin": r"(?:[BYOP*&|<TA=]|>{1,2})",
    "op0": r"<pre><simple><post>(?:as<type>)*",
    "e0": r"<op0>(?:<bin>(?:<op0>)|T)*",
    "cond": r"(?:let<pat>=)?<e0>(?:Ylet<pat>=<e0>)*",
    "if": r"if<cond><C.block>(?:elseif<cond><C.block>)*(?:else<C.block>)?",
    "blocky": r"(?:L:)?(?:<if>|match<e0><C.match>|while<cond><C.block>|for<pat>in<e0><C.block>|loop<C.block>|unsafe<C.block>|<C.block>)",
    "op": r"(?:<pre>(?:<blocky>|<simple>)<post>(?:as<type>)*)",
    "expr": r"(?:<op>(?:<bin><op>|T)*|T)",
    "where": r"(?:where(?:(?:for<targs>)?(?:L|<type>):<bound>?(?:P<bound>)*,?)*)?",
    "fn": r"(?:const|async|unsafe|externs?|default)*fni<targs>?<P.params>(?:R<type>)?<where>(?:<C.block>|;)",
    "item": r"(?:<attr>)*<vis>(?:<fn>|structi<targs>?(?:<where><C.fields>|<P.tfields><where>;|;)|enumi<targs>?<where><C.variants>|(?:unsafe)?impl<targs>?!?<type>(?:for<type>)?<where><C.items>|(?:unsafe)?traiti<targs>?(?::<bound>?(?:P<bound>)*)?<where><C.items>|modi(?:;|<C.items>)|use<use>;|(?:const|staticmut|static)i:<type>(?:=<expr>)?;|typei<targs>?(?::<bound>(?:P<bound>)*)?<where>(?:=<type>)?<where>;|extern(?:s?<C.items>|cratei(?:asi)?;)|<path>!i?(?:<C.any>|(?:<P.any>|<K.any>);))",
    "use": r"D?(?:(?:<seg>D)*(?:<seg>(?:asi)?|\*|<C.use>)|<C.use>|\*)",
    "let": r"let<pat>(?::<type>)?(?:=<expr>(?:else<C.block>)?)?;",
    "stmt": r"(?:;|(?:<attr>)*<let>|<item>|(?:<attr>)*<blocky>|(?:<attr>)*<path>!<C.any>|(?:<attr>)*<expr>;)",
    "roles": {
        "C": {
            "any": ANY, "block": r"(?:\#!<K.any>)*<stmt>*(?:<expr>)?", "struct": r"(?:(?:<attr>)*[ni](?::<expr>)?,)*(?:(?:<attr>)*[ni](?::<expr>)?|T<expr>?)?", "match": r"(?:(?:<attr>)*<pat>(?:if<cond>)?F(?:<C.block>,?|<blocky>,?|<expr>,))*(?:(?:<attr>)*<pat>(?:if<cond>)?F<expr>)?",
            "fields": r"(?:(?:<attr>)*<vis>i:<type>,)*(?:(?:<attr>)*<vis>i:<type>)?", "variants": r"(?:(?:<attr>)*i(?:<P.tfields>|<C.fields>)?(?:=<expr>)?,)*(?:(?:<attr>)*i(?:<P.tfields>|<C.fields>)?(?:=<expr>)?)?",
            "items": r"(?:\#!<K.any>)*<item>*", "use": r"(?:<use>(?:,<use>)*,?)?", "pats": r"(?:(?:(?:ref|mut)*[ni](?::<pat>)?),)*(?:(?:ref|mut)*[ni](?::<pat>)?|T)?",
        },
        "P": {
            "any": ANY, "args": r"(?:<expr>(?:,<expr>)*,?)?", "tuple": r"(?:<expr>(?:,<expr>)*,?)?", "types": r"(?:(?:i:)?<type>(?:,(?:i:)?<type>)*,?)?", "pats": r"(?:<pat>(?:,<pat>)*,?)?",
            "params": r"(?:(?:<attr>)*(?:(?:&L?)?(?:mut)?self(?::<type>)?|<pat1>:<type>|T)(?:,(?:<attr>)*<pat1>:<type>)*,?)?", "tfields": r"(?:(?:<attr>)*<vis><type>(?:,(?:<attr>)*<vis><type>)*,?)?",
        },
        "K": {"any": ANY, "array": r"(?:<expr>(?:,<expr>)*,?|<expr>;<expr>|<type>(?:;<expr>)?)?", "pats": r"(?:<pat>(?:,<pat>)*,?)?"},
    },
    "top": r"(?:\#!<K.any>)*<item>*",
}

KOTLIN = {
    "id": r"[im]",
    "ann": r"@<id>(?:\.<id>)*(?::<id>)?<P.args>?N*",
    "mods": r"(?:m|<ann>)*",
    "targs": r"<(?:[im.,<>?*:&]|in|<P.types>|R|<ann>)*>",
    "type1": r"(?:<ann>)*(?:<id><targs>?(?:\.<id><targs>?)*|<P.types>)\?*",
    "type": r"(?:m(?=[i(-]))?<type1>(?:\.<P.types>)?(?:R<type1>)*(?:&<type1>)*",
    "pre": r"(?:[P!U]|<ann>|<id>@|return(?:@<id>)?|throw)*",
    "when": r"when<P.when>?<C.when>",
    "try": r"try<C.lambda>(?:catch<P.params><C.lambda>)*(?:finally<C.lambda>)?",
    "prim": r"(?:[ns]|<id>|this(?:@<id>)?|super(?:<targs>)?(?:@<id>)?|null|true|false|<P.paren>|<C.lambda>|<K.list>|<when>|<try>|object(?::<super>(?:,<super>)*)?<C.class>|fun(?:<type>\.)?<P.params>(?::<type>)?<C.lambda>|D(?:<id>|class)|break(?:@<id>)?|continue(?:@<id>)?)",
    "post": r"(?:\.(?:<id>|class|<P.paren>)|<targs>(?=[--])|<P.args>|<K.list>|<C.lambda>|(?:<id>@)<C.lambda>|U|Q|\?*D(?:<id>|class))*",
    "op0": r"(?:<pre><prim><post>|<pre>return(?:@<id>)?)",
    "bin": r"(?:[BYOP*<>T|&]|!?in|i)",
    "e0": r"<op0>(?:<bin><op0>|as\??<type>|!?is<type>)*",
    "branch": r"(?:<e0>(?:[=A]<e0>)?|;)",
    "if": r"if<P.paren><branch>?(?:;?elseif<P.paren><branch>)*(?:;?else<branch>)?",
    "op": r"<pre>(?:<if>|<prim><post>)|<pre>return(?:@<id>)?",
    "expr": r"(?:<op>)(?:<bin>(?:<op>)|as\??<type>|!?is<type>)*",
    "super": r"(?:<ann>)*<type1><P.args>?(?:i<e0>)?",
    "var": r"(?:<mods>(?:val|var)<targs>?(?:<P.params>|(?:<type1>\.)?<id>(?::<type>)?)(?:N*=N*<expr>|i<expr>)?(?:[N;]*<mods>i<P.params>(?::<type>)?(?:=<expr>|<C.lambda>)?){0,2})",
    "fun": r"(?:<mods>fun<targs>?(?:<type1>\.)?<id><P.params>(?::<type>)?(?:where<id>:<type>)?(?:=N*<expr>|N?<C.lambda>)?)",
    "cls": r"(?:<mods>(?:class|interface|funinterface)<id><targs>?(?:<mods>i?<P.params>)?(?::N?<super>(?:,N?<super>)*)?N?<C.class>?|<mods>object<id>?(?::<super>(?:,<super>)*)?<C.class>?|<mods>typealias<id><targs>?=<type>)",
    "loop": r"(?:(?:<id>@)?(?:for<P.forin>|while<P.paren>))",
    "stmt": r"(?:(?:<loop>)*(?:<var>|<fun>|<cls>|do<C.lambda>N?while<P.paren>|(?:<e0>[=A])+<expr>|<expr>)|(?:<loop>)+;?)",
    "seq": r"[N;]*(?:<stmt>(?:[N;]+<stmt>)*[N;]*)?",
    "member": r"(?:<var>|<fun>|<cls>|<id><C.lambda>|<mods>i<P.params>(?::(?:this|super)<P.args>)?<C.lambda>?)",
    "constant": r"(?:<ann>)*<id><P.args>?<C.class>?",
    "cond": r"(?:!?in<e0>|!?is<type>|<expr>)",
    "roles": {
        "C": {
            "lambda": r"N*(?:(?:<P.params>|(?:<id>|<P.params>)(?::<type>)?(?:,(?:<id>|<P.params>)(?::<type>)?)*)?R)?<seq>", "class": r"[N;]*(?:<constant>(?:N*,N*<constant>)*,?(?:N*;<memberseq>)?|<member>(?:[N;]+<member>)*)?[N;]*",
            "when": r"[N;]*(?:(?:<cond>(?:,N*<cond>)*,?|else)RN*(?:<stmt>)(?:[N;]+|(?=else)|\Z))*",
        },
        "P": {
            "args": r"(?:(?:<id>=)?\*?<expr>(?:,(?:<id>=)?\*?<expr>)*,?)?", "paren": r"<expr>", "types": r"(?:(?:<id>:)?<type>(?:,(?:<id>:)?<type>)*,?)?", "when": r"(?:val<id>(?::<type>)?=)?<expr>",
            "params": r"(?:<mods>(?:val|var)?<id>(?::<type>)?(?:=<expr>)?(?:,<mods>(?:val|var)?<id>(?::<type>)?(?:=<expr>)?)*,?)?", "forin": r"(?:<id>(?::<type>)?|<P.params>)in<expr>",
        },
        "K": {"list": r"(?:<expr>(?:,<expr>)*,?)?"},
    },
    "memberseq": r"[N;]*(?:<member>(?:[N;]+<member>)*)?",
    "top": r"N*(?:<ann>N*)*(?:package<id>(?:\.<id>)*(?:[N;]+|\Z))?(?:import<id>(?:\.<id>)*(?:\.\*|as<id>)?(?:[N;]+|\Z))*(?:(?:<var>|<fun>|<cls>)(?:[N;]+|\Z))*",
}

_JSKEYS = "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof let new null return super switch this throw true try typeof var void while with yield async await of static get set"
JS = {
    "id": r"(?:i|async|of|get|set|static|let)",
    "key": rf"(?:i|{'|'.join(_JSKEYS.split())}|m)",
    "t": "", "gen": "", "opt": "", "ret": "", "mods": "(?:static)?", "impl": "", "tsdecl": "(?!)", "tsmember": "(?!)", "asop": "(?!)", "nonnull": "(?!)", "nonempty": "",
    "prop": r"(?:[sn]|<key>|<K.index>|\#<key>)",
    "head": r"(?:async)?(?:<id>|<gen><P.params><ret>)F",
    "pre": r"(?:[P!U]|typeof|void|delete|await|yield\*?|<head>)*",
    "fn": r"(?:async)?function\*?<id>?<gen><P.params><ret><C.body>",
    "classexpr": r"class(?:<id>)?<gen>(?:extends<lhs>)?<impl><C.class>",
    "lhs": r"(?:<id>|this|super|<P.paren>|<fn>)(?:\.<key>|<P.args>|<K.index>)*(?:<gen>)",
    "prim": r"(?:[ns]|<id>|this|super|null|true|false|<P.paren>|<K.array>|<C.object>|<fn>|<classexpr>|new(?:\.i|(?:<id>|this|<P.paren>|<fn>|<classexpr>)(?:\.<key>|<K.index>)*<gen><P.args>?)|import(?:<P.args>|\.i)|\#i)",
    "post": r"(?:\.(?:<key>|\#<key>|<P.args>|<K.index>)|<gen><P.args>|<K.index>|U|s|<nonnull>)*",
    "operand": r"(?:<pre><prim><post><asop>*|<pre><head><C.body><asop>*)",
    "bin": r"(?:[BYOP*&|<]|>{1,3}|in|instanceof)",
    "b1": r"<operand>(?:<bin><operand>)*",
    "tern": r"<b1>(?:\?<b1>(?:\?<b1>:<b1>)?:<b1>)*",
    "assign": r"(?:(?:<head>)*(?:<tern>)[=A])*(?:<tern>|yield)",
    "expr": r"<assign>(?:,<assign>)*",
    "bind": r"(?:<id>|<C.object>|<K.array>)!?<t>(?:=<assign>)?",
    "decl": r"(?:var|let|const)<bind>(?:,<bind>)*",
    "end": r"(?:[;N]+|\Z)",
    "try": r"try<C.block>(?:catch<P.params>?<C.block>(?:finally<C.block>)?|finally<C.block>)",
    "func": r"(?:async)?function\*?<id><gen><P.params><ret>(?:<C.body>|<end>)",
    "exprstart": r"(?!function|class|async(?:function)|[-])",
    "heads": r"(?:<id>:N?|(?:for(?:await)?<P.for>|while<P.paren>|with<P.paren>)N?)*",
    "core": r"(?:<C.block>[N]*|;+N*|<decl><end>|<func>|class<id><gen>(?:extends<lhs>)?<impl><C.class>N*|<try>N*|switch<P.paren><C.switch>N*|throw<expr><end>|break(?:i)?<end>|continue(?:i)?<end>|debugger<end>|doN?(?:<C.block>|<exprstart><expr>[;N]+)N?while<P.paren><end>?|<exprstart><expr><end>)",
    "rcore": r"(?:<C.body>[N]*|return<expr>?<end>|switch<P.paren><C.rswitch>N*|try<C.body>(?:catch<P.params>?<C.body>(?:finally<C.body>)?|finally<C.body>)N*|doN?<C.body>N?while<P.paren><end>?|<core>)",
    "body": r"<heads>(?:<core>|if<P.paren>N?<heads><core>(?:else(?!if)N?<heads><core>)?)",
    "rbody": r"<heads>(?:<rcore>|if<P.paren>N?<heads><rcore>(?:else(?!if)N?<heads><rcore>)?)",
    "if": r"if<P.paren>N?<body>(?:elseif<P.paren>N?<body>)*(?:elseN?<body>)?",
    "rif": r"if<P.paren>N?<rbody>(?:elseif<P.paren>N?<rbody>)*(?:elseN?<rbody>)?",
    "stmt": r"(?:<heads>(?:<if>|<core>)|<tsdecl>)",
    "rstmt": r"(?:<heads>(?:<rif>|<rcore>)|<tsdecl>)",
    "param": r"(?:<ann>)*<pmods>T?(?:<id>|this|<C.object>|<K.array>)<opt><t>(?:=<assign>)?",
    "pmods": "", "ann": r"@<id>(?:\.<id>)*<P.args>?",
    "method": r"(?:<ann>N?)*<mods>(?:static)?(?:async)?\*?(?:get|set)?<prop><opt><gen><P.params><ret>",
    "objprop": r"(?:(?:async)?\*?(?:get|set)?<prop><gen><P.params><ret><C.body>|T<assign>|<prop>:<assign>|<id>(?:=<assign>)?)",
    "member": r"(?:<method>(?:<C.body>N*|<nonempty><end>)|(?:<ann>N?)*<mods>(?:static)?<prop>[?!]?<t>(?:=<assign>)?<end>|static<C.body>|[;N]|<tsmember>)",
    "asw": "i",
    "module": r"(?:import(?:s|<importwhat>i(?:s))(?:i<C.object>)?<end>|export(?:<exportwhat><end>|default(?:<func>|(?:async)?function\*?<gen><P.params><ret><C.body>N*|class<gen>(?:extends<lhs>)?<impl><C.class>N*|<assign><end>)|<decl><end>|<func>|class<id><gen>(?:extends<lhs>)?<impl><C.class>N*|(?:<ann>N?)+class<id><gen>(?:extends<lhs>)?<impl><C.class>N*|<tsdecl>))",
    "importwhat": r"(?:<tyonly>(?:<id>(?:,(?:<C.names>|\*<asw><id>))?|<C.names>|\*<asw><id>))", "exportwhat": r"(?:<tyonly>(?:<C.names>(?:i(?:s))?|\*(?:<asw>(?:<id>|s))?i(?:s)))", "tyonly": "",
    "roles": {
        "C": {
            "block": r"N*(?:<stmt>N*)*", "body": r"N*(?:<rstmt>N*)*", "object": r"N*(?:<objprop>N*(?:,N*<objprop>N*)*,?N*)?", "class": r"(?:<member>)*",
            "switch": r"N*(?:(?:case<expr>|default):N*(?:<stmt>N*)*)*", "rswitch": r"N*(?:(?:case<expr>|default):N*(?:<rstmt>N*)*)*", "names": r"(?:<tyonly>(?:<key>|s)(?:<asw>(?:<key>|s))?(?:,<tyonly>(?:<key>|s)(?:<asw>(?:<key>|s))?)*,?)?",
        },
        "P": {"args": r"(?:T?<assign>(?:,T?<assign>)*,?)?", "paren": r"<expr>", "params": r"(?:<param>(?:,<param>)*,?)?", "for": r"(?:<decl>|<expr>)?;<expr>?;<expr>?|(?:(?:var|let|const)(?:<id>|<C.object>|<K.array>)|<lhs>|<K.array>|<C.object>)(?:in|of)<expr>"},
        "K": {"array": r"(?:(?:T?<assign>)?,)*(?:T?<assign>)?", "index": r"<expr>"},
    },
    "top": r"N*(?:(?:<module>|<stmt>)N*)*",
}

_TSKEYS = KEYWORDS["ts"]
TS = JS | {
    "id": r"(?:i|async|of|get|set|static|let|type|namespace|declare|abstract|readonly|keyof|infer|unique|satisfies|as|is|private|public|protected|implements|interface)",
    "key": rf"(?:i|{'|'.join(_TSKEYS.split())})",
    "t0": r"(?:(?:keyof|readonly|unique|infer|typeof|asserts)*(?:[ns]|P n|<id>(?:\.<id>)*<targs>?|this|null|void|true|false|<C.type>|<K.type>|<P.type>|new<gen><P.params>F|import<P.args>(?:\.<id>)*<targs>?)(?:<K.type>|<K.empty>)*)".replace("P n", "Pn").replace("|asserts", ""),
    "targs": r"<(?:[sni.,<>|&?:=FP]|null|void|this|typeof|keyof|readonly|extends|infer|true|false|in|new|<id>|<C.type>|<K.type>|<K.empty>|<P.type>|<P.params>)*>",
    "ty1": r"(?:<gen><P.params>F)*<t0>",
    "ty": r"[|&]?<ty1>(?:[|&]<ty1>|extends<ty1>\?<ty1>:<ty1>|is<ty1>)*",
    "t": r"(?::<ty>)?", "gen": r"(?:<targs>)?", "opt": r"\??", "ret": r"(?::<ty>)?", "mods": r"(?:private|public|protected|readonly|abstract|static|declare|<key0>)*", "key0": "(?!)",
    "impl": r"(?:implements<ty1>(?:,<ty1>)*)?", "asop": r"(?:(?:as|satisfies)(?:const|<ty>))", "nonnull": r"!", "pmods": r"(?:private|public|protected|readonly)*", "tyonly": r"(?:type)?",
    "tsmembers": r"N*(?:<tsm>(?:[;,N]+<tsm>)*[;,N]*)?",
    "tsm": r"(?:(?:readonly|P?readonly)?(?:get|set)?<prop>\??(?:<gen><P.params>)?<t>|(?:new)?<gen><P.params><t>|(?:P?readonly)?<K.type>P?\??<t>)",
    "tsdecl": r"(?:(?:declare)?(?:interface<id><gen>(?:extends<ty1>(?:,<ty1>)*)?<C.type>N*|type<id><gen>=<ty><end>|(?:const)?enum<id><C.enum>N*|namespace<id>(?:\.<id>)*<C.ns>N*|abstractclass<id><gen>(?:extends<lhs>)?<impl><C.class>N*|i<C.ns>N*)|declare(?:<func>|<decl><end>|class<id><gen>(?:extends<lhs>)?<impl><C.class>N*))",
    "asw": "as",
    "tsmember": r"(?:<mods>readonly?<K.type><t><end>)", "nonempty": "",
}
TS["roles"] = {
    "C": JS["roles"]["C"] | {"type": r"<tsmembers>", "enum": r"N*(?:(?:<key>|s)(?:=<assign>)?(?:,N*(?:<key>|s)(?:=<assign>)?)*,?)?N*"},
    "P": JS["roles"]["P"] | {"type": r"(?:T?(?:<id>\??:)?<ty>(?:,T?(?:<id>\??:)?<ty>)*,?)?"},
    "K": JS["roles"]["K"] | {"type": r"(?:T?(?:<id>\??:)?<ty>(?:,T?(?:<id>\??:)?<ty>)*,?|<id>in<ty>(?:as<ty>)?|<id>:<ty>)", "empty": r""},
}
TS["roles"]["C"]["ns"] = r"N*(?:(?:<module>|<stmt>)N*)*"

PY = {
    "pre": r"(?:[P!]|not|await|lambda(?:<lparams>)?:)*",
    "lparams": r"(?:(?:\*{0,1}i(?:=<tern0>)?|\*|B(?:i)?|B)(?:,(?:\*?i(?:=<tern0>)?|\*|Bi|B))*,?)",
    "prim": r"(?:i|n|s+|None|True|False|<P.any>|<K.any>|<C.any>|T)",
    "post": r"(?:\.i|<P.any>|<K.index>)*",
    "operand": r"<pre><prim><post>",
    "bin": r"(?:[BP*&|<@]|>{1,2}|and|or|notin|in|isnot|is)",
    "b0": r"(?:[P!]|not|await)*<prim><post>(?:<bin>(?:[P!]|not|await)*<prim><post>)*",
    "tern0": r"<b0>(?:if<b0>else<b0>)*",
    "b1": r"<operand>(?:<bin><operand>)*",
    "expr": r"<b1>(?:if<b1>else<b1>)*",
    "star": r"(?:\*?<expr>)",
    "list": r"<star>(?:,<star>)*,?",
    "yield": r"yield(?:from<expr>|<list>)?",
    "value": r"(?:<yield>|<list>)",
    "target": r"(?:<star>(?:,<star>)*,?)",
    "dotted": r"i(?:\.i)*",
    "simple": r"(?:(?:<target>=)*<value>|<b1>:<expr>(?:=<value>)?|<b1>A<value>|return<list>?|pass|break|continue|raise(?:<expr>(?:from<expr>)?)?|del<target>|assert<expr>(?:,<expr>)?|(?:global|nonlocal)i(?:,i)*|import<dotted>(?:asi)?(?:,<dotted>(?:asi)?)*|from[.T]*<dotted>?import(?:\*|<P.any>|i(?:asi)?(?:,i(?:asi)?)*))",
    "simples": r"(?:<simple>(?:;<simple>)*;?|@<named>)",
    "header": r"(?:if<named>|elif<named>|else|(?:async)?for<target>in<list>|while<named>|try|finally|except(?:\*?<expr>(?:,<expr>)*(?:asi)?)?|(?:async)?with<expr>(?:as<star>)?(?:,<expr>(?:as<star>)?)*|(?:async)?defi<K.any>?<P.params>(?:R<expr>)?|classi<K.any>?<P.any>?|i<list>(?:if<named>)?):",
    "named": r"(?:iW)?<expr>",
    "comp": r"(?:(?:async)?for<target>in<b1>(?:if<b1>)*)+",
    "roles": {
        "P": {"any": r"(?:(?:(?:i=|iW|\*|B)?<expr>|<yield>)(?:<comp>)?(?:,(?:i=|iW|\*|B)?<expr>(?:<comp>)?|,i(?:asi)?)*,?|i(?:asi)?(?:,i(?:asi)?)*,?)?", "params": r"(?:(?:\*?i(?::<expr>)?(?:=<expr>)?|\*|Bi(?::<expr>)?|B)(?:,(?:\*?i(?::<expr>)?(?:=<expr>)?|\*|Bi(?::<expr>)?|B))*,?)?"},
        "K": {"any": r"(?:<star>(?:<comp>|(?:,<star>)*,?))?", "index": r"(?:\*?(?:iW)?<expr>?(?::<expr>?){0,2})(?:,\*?<expr>?(?::<expr>?){0,2})*"},
        "C": {"any": r"(?:(?:<expr>:<expr>|B<expr>)(?:<comp>|(?:,(?:<expr>:<expr>|B<expr>))*,?)|<star>(?:<comp>|(?:,<star>)*,?))?"},
    },
    "top": ANY,
}

#: Macros that are matched once, longest first, and not taken back: what bounds the work on a window to its length.
ATOMIC = {
    "json": (), "go": ("stmt", "decl", "type"), "java": ("tern", "stmt", "member", "operand"), "rs": ("stmt", "item", "type", "pat"), "kt": ("stmt", "member", "type1", "when"),
    "js": ("tern", "assign", "stmt", "rstmt", "member", "objprop", "operand"), "ts": ("tern", "assign", "stmt", "rstmt", "member", "objprop", "operand"), "py": (),
}

#: What a plain statement is, and which roles of curly brackets are made of statements: those windows are matched without
#: their plain statements, which are matched one by one, as each of them comes again and again.
PLAIN = {
    "go": (r"(?:(?:go|defer)<expr>|<simple>);", ("block",)), "java": (r"(?:<effect>;|<locals>;|throw<expr>;)", ("block",)), "rs": (r"(?:<let>|<expr>;)", ("block",)),
    "kt": (r"(?:<var>|(?:<e0>[=A])+<expr>|<expr>)N", ("lambda",)), "js": (r"(?:<decl>|throw<expr>|<exprstart><expr>)[;N]", ("block", "body")), "ts": (r"(?:<decl>|throw<expr>|<exprstart><expr>)[;N]", ("block", "body", "ns")),
}
#: Words that begin a statement after a block; ``else``, ``catch``, ``while`` and the like go on with the one before.
_BEGIN = "".join(map(keyword, ("if", "for", "switch", "match", "return", "throw", "try", "let", "const", "var", "val", "loop", "break", "continue")))
_BLOCKS = f"[{chr(BASE['C'])}-{chr(BASE['C'] + SYMBOLS['C'] - 1)}]"
_PIECES = {lang: re.compile(f"(?<=N)|(?<={_BLOCKS})(?=[{_BEGIN}])" if lang == "kt" else f"(?<=[;N])|(?<={_BLOCKS})(?=[{_BEGIN}])") for lang in PLAIN}
#: Equal list items, and equal statements from the start of a statement on: a run of them stands or falls with two of them.
#: Headers have a fixed number of clauses, so ``;`` is left alone in windows that are no blocks, and after the first clause of a
#: header without brackets.
_REPEATED_ITEMS = re.compile(r"([^,;N]{1,60},)\1{2,}")
_REPEATED = re.compile(r"([^,;N]{1,60},)\1{2,}|(?<![^;N])([^,;N]{1,60}[;N])\2{2,}")

GRAMMARS = {"json": JSON, "go": GO, "java": JAVA, "rs": RUST, "kt": KOTLIN, "js": JS, "ts": TS, "py": PY}


_TOKEN = re.compile(r"\(\?[:=!]|\\.|<([a-zA-Z][\w.]*)>|[A-Za-z]{2,}|.", re.S)


class Grammar:
    """One compiled pattern of a language: all macros once, and behind a marker each role of a window and the whole file."""

    def __init__(self, lang: str):
        self.lang, self.spec = lang, GRAMMARS[lang]
        self.words = frozenset(KEYWORDS[lang].split())
        self.roles = {k: list(v) for k, v in self.spec["roles"].items()}
        self.starts = {(k, r): self.spec["roles"][k][r] for k, v in self.roles.items() for r in v} | {("", "top"): self.spec["top"]}
        if lang in PLAIN:
            self.starts[("", "plain")] = PLAIN[lang][0]
        if lang == "py":
            self.starts |= {("", "simple"): "<simples>", ("", "header"): "<header>(?:<simples>)?"}
        self.marker = {start: chr(0xF900 + i) for i, start in enumerate(self.starts)}
        defined: dict[str, str] = {}
        todo = [m for t in self.starts.values() for m in self.uses(t)]
        while todo:
            if (name := todo.pop()) not in defined:
                kind, _, role = name.partition(".")
                defined[name] = self.symbol(kind, role) if role else self.expand(self.spec[name])
                todo += [] if role else self.uses(self.spec[name])
        body = "".join(f"(?P<{self.group(n)}>{d})" for n, d in defined.items())
        calls = "|".join(f"{self.marker[start]}(?:{self.expand(t)})" for start, t in self.starts.items())
        self.pattern = regex.compile(f"(?(DEFINE){body})(?:{calls})")
        self.known: dict[str, bool] = {}
        self.memo: dict[str, str] = {}
        self.lines: dict[str, int] = {}
        # what a window of each role can show at most: a window with another pair of classes is not matched at all
        flat = Adjacency(self, {k: (chr(b), chr(b)) for k, b in BASE.items()})
        self.flat = {start: None if template == ANY else flat.within(start) for start, template in self.starts.items()}

    @staticmethod
    def shape(text: str) -> set[tuple[str, str]]:
        """The pairs of a flat window, reduced windows by their kind."""
        text = text.translate(_KINDS)
        return set(zip(BEGIN + text, text + END, strict=True))

    def fits(self, start: tuple[str, str], text: str) -> bool:
        key = self.marker[start] + text
        known = self.known.get(key)
        if known is None:
            if len(self.known) > 200_000:
                self.known.clear()
            known = self.known[key] = self.pattern.fullmatch(key) is not None
        return known

    def without_plain(self, content: str) -> str:
        """A statement window without its plain statements; a statement that hangs on a header before it stays."""
        kept, hanging, controls = [], False, set()
        for piece in _PIECES[self.lang].split(content):
            if not piece:
                continue
            if hanging or piece in ";N" or not self.fits(("", "plain"), piece):
                if not hanging and piece[0] in _CONTROL and _CURLY.match(piece[-1]):
                    if piece in controls:
                        continue
                    controls.add(piece)
                kept.append(piece)
                closed = _CURLY.search(piece) is not None
                if self.lang == "go":  # a header has semicolons of its own
                    hanging = not closed and (hanging or piece[0] in _GO_HEADERS)
                else:
                    hanging = not closed and len(piece) > 1 and piece[-1] == "N" and piece[0] in _HEADERS
        return "".join(kept)

    @staticmethod
    def group(name: str) -> str:
        return "m_" + name.replace(".", "_")

    def is_macro(self, name: str | None) -> bool:
        return bool(name) and (name in self.spec or name[:2] in ("P.", "K.", "C."))

    def uses(self, template: str) -> list[str]:
        return [m.group(1) for m in _TOKEN.finditer(template) if self.is_macro(m.group(1))]

    def symbol(self, kind: str, role: str) -> str:
        bit = 1 << self.roles[kind].index(role)
        return "[" + "".join(chr(BASE[kind] + m) for m in range(1 << len(self.roles[kind])) if m & bit) + "]"

    def expand(self, template: str, call=None) -> str:
        call = call or (lambda name: f"(?>(?&{self.group(name)}))" if name in ATOMIC[self.lang] else f"(?&{self.group(name)})")
        out = []
        for m in _TOKEN.finditer(template):
            t = m.group()
            if self.is_macro(m.group(1)):
                out.append(call(m.group(1)))
            elif m.group(1):
                out.append("<" + self.spell(m.group(1)) + ">")
            else:
                out.append(self.spell(t) if len(t) > 1 and t.isalpha() else t)
        return "".join(out)

    def spell(self, run: str) -> str:
        """A run of letters: keywords, longest first, and single classes between them."""
        out, at = [], 0
        while at < len(run):
            for end in range(len(run), at + 1, -1):
                if run[at:end] in self.words:
                    out.append(keyword(run[at:end]))
                    at = end
                    break
            else:
                out.append(run[at])
                at += 1
        return "".join(out)

    def reduce_window(self, window: str) -> str:
        symbol = self.memo.get(window)
        if symbol is None:
            kind, content = KIND[window[0]], window[1:-1]
            if self.lang == "py":
                content = re.sub(INDENTS, "", content)
            elif kind != "C":
                content = content.replace("N", "")
            content = _REPEATED.sub(r"\1\1\2\2", content) if kind == "C" else _REPEATED_ITEMS.sub(r"\1\1", content)
            plain = PLAIN[self.lang][1] if kind == "C" and self.lang in PLAIN else ()
            bare = self.without_plain(content) if plain else content
            shown = {False: self.shape(content)}
            shown[True] = shown[False] if bare == content else self.shape(bare)
            mask = 0
            for i, role in enumerate(self.roles[kind]):
                start, without = (kind, role), role in plain
                if (self.flat[start] is None or shown[without] <= self.flat[start]) and self.fits(start, bare if without else content):
                    mask |= 1 << i
            if len(self.memo) > 100_000:
                self.memo.clear()
            symbol = self.memo[window] = chr(BASE[kind] + mask) if mask else FAILED
        return symbol

    def accepts(self, kinds: str) -> bool:
        """Whether a class string with its statement ends (:func:`terminate`) is a whole file of the language."""
        if "E" in kinds:
            return False
        while True:
            reduced = _INNER.sub(lambda m: self.reduce_window(m.group()), kinds)
            if FAILED in reduced:
                return False
            if reduced == kinds:
                break
            kinds = reduced
        if any(c in kinds for c in "()[]{}"):
            return False
        return self.python(kinds) if self.lang == "py" else self.fits(("", "top"), _REPEATED.sub(r"\1\1\2\2", kinds))

    def python(self, kinds: str) -> bool:
        """Logical lines against the statement productions, and their indentation against the blocks that they open."""
        levels, opened, last = [0], False, {0: ""}
        for line in re.finditer(f"({INDENTS})([^{INDENTS[1:-1]}]+)", kinds):
            width, body = ord(line.group(1)) - INDENT, line.group(2)
            ok = self.lines.get(body)
            if ok is None:
                ok = self.lines[body] = (2 if body.endswith(":") else 1) if self.fits(("", "header"), body) else int(self.fits(("", "simple"), body))
            if not ok:
                return False
            if opened:
                if width <= levels[-1]:
                    return False
                levels.append(width)
                last[width] = ""
            elif width > levels[-1]:
                return False
            while width < levels[-1]:
                levels.pop()
            if width != levels[-1]:
                return False
            first = body[0]
            if first in (keyword("elif"), keyword("else"), keyword("except"), keyword("finally")):
                before = last.get(width, "")
                allowed = {keyword("elif"): ("if", "elif"), keyword("else"): ("if", "elif", "for", "while", "except"), keyword("except"): ("try", "except"), keyword("finally"): ("try", "except", "else")}[first]
                if before not in map(keyword, allowed):
                    return False
            last[width] = body[1] if first == keyword("async") and len(body) > 1 else first
            opened = ok == 2
        return not opened


#: Reduced windows to the first symbol of their kind.
_KINDS = {b + m: chr(b) for k, b in BASE.items() for m in range(SYMBOLS[k])}
_HEADERS = frozenset(map(keyword, ("if", "else", "for", "while", "do", "with")))
_CONTROL = frozenset(map(keyword, ("if", "for", "switch", "match", "try", "loop")))
_GO_HEADERS = frozenset(map(keyword, ("if", "for", "switch", "select", "else")))
_CURLY = re.compile(_BLOCKS)
_GO_END = "insU)\\]}" + "".join(map(keyword, ("break", "continue", "fallthrough", "return")))
_ELSE = "".join(map(keyword, ("else", "catch", "finally")))
_KT_END = "insUQ)\\]}m?>" + "".join(map(keyword, ("break", "continue", "return", "this", "super", "null", "true", "false")))
_KT_NEXT = ".,)\\]:=BYOA" + _ELSE + "".join(map(keyword, ("as",)))
_JS_END = "insU)\\]}!>" + "".join(map(keyword, ("break", "continue", "return", "this", "super", "null", "true", "false", "async", "of", "get", "set", "static", "void", "type", "yield", "debugger")))
_JS_NEXT = ".,)(\\[\\];:?=ABYO*&|<>" + _ELSE + "".join(map(keyword, ("instanceof", "in")))


@lru_cache(maxsize=None)
def _terminators(lang: str):
    if lang == "go":
        return re.compile(f"(?<![{_GO_END}])N"), ";"
    if lang == "kt":
        return re.compile(f"(?<![{_KT_END}])N|N(?=[{_KT_NEXT}])"), "N"
    if lang in ("js", "ts"):
        return re.compile(f"(?<![{_JS_END}])N|N(?=[{_JS_NEXT}])"), "N"
    return None


def terminate(lang: str, kinds: str) -> str:
    """Line ends to statement ends, as the language has it."""
    if lang == "py":
        return re.sub(f"{INDENTS}+(?={INDENTS})|{INDENTS}+\\Z", "", kinds)
    kinds = re.sub("NN+", "N", kinds)
    rule = _terminators(lang)
    if rule is None:
        return kinds.replace("N", "")
    drop, end = rule
    kinds = drop.sub("", kinds)
    return kinds.replace("N", end) if end != "N" else kinds


@lru_cache(maxsize=None)
def grammar(lang: str) -> Grammar:
    return Grammar(lang)


class Adjacency:
    """Which token classes may follow each other inside each macro and start of a grammar, without the macros below it.

    ``ends`` gives the first and the last class of a reduced window of each bracket kind.
    """

    def __init__(self, g: Grammar, ends: dict[str, tuple[str, str]]):
        from re import _parser as parser

        self.g, self.ends, self.names, self.trees = g, ends, {}, {}
        self.everything = frozenset("insNUPAWRFDTQBLYO!*&<>|=?.@#$,:;m()[]{}") | set(map(keyword, g.words))

        def tree(template: str):
            return parser.parse(g.expand(template, lambda n: self.names.setdefault(n, chr(0xFB00 + len(self.names)))))

        todo = list(g.starts)
        while todo:
            name = todo.pop()
            if name not in self.trees and "." not in name:
                template = g.starts[name] if isinstance(name, tuple) else g.spec[name]
                self.trees[name] = tree(template)
                todo += g.uses(template)
        self.macro = {c: n for n, c in self.names.items()}
        nothing = (False, frozenset(), frozenset())
        self.known = {name: nothing for name in self.trees}
        self.pairs: dict[object, set[tuple[str, str]]] = {}
        before = None
        # macros may hold each other: what an earlier pass found stands in, and passes go on until nothing is new
        while before != self.known:
            before = dict(self.known)
            for name, t in self.trees.items():
                self.pairs[name] = set()
                self.known[name] = self.walk(t, self.pairs[name])
        for start in g.starts:
            empty, first, last = self.known[start]
            self.pairs[start] |= {(BEGIN, c) for c in first} | {(c, END) for c in last} | ({(BEGIN, END)} if empty else set())

    def of(self, name: str) -> tuple[bool, frozenset, frozenset]:
        kind, _, role = name.partition(".")
        if role:
            first, last = self.ends[kind]
            return False, frozenset(first), frozenset(last)
        return self.known[name]

    def walk(self, tree, pairs: set) -> tuple[bool, frozenset, frozenset]:
        """(may be empty, first classes, last classes) of a parsed production; its pairs go into ``pairs``."""
        from re import _constants as C

        empty, first, last = True, frozenset(), frozenset()
        for op, arg in tree:
            if op is C.LITERAL and chr(arg) in self.macro:
                e, f, la = self.of(self.macro[chr(arg)])
            elif op is C.LITERAL:
                e, f, la = False, frozenset(chr(arg)), frozenset(chr(arg))
            elif op is C.IN:
                parts = [self.of(self.macro[chr(a)]) for o, a in arg if o is C.LITERAL and chr(a) in self.macro]
                chars: set[str] = set()
                for o, a in arg:
                    if o is C.LITERAL:
                        chars |= set() if chr(a) in self.macro else {chr(a)}
                    else:
                        chars |= set(map(chr, range(a[0], a[1] + 1))) if o is C.RANGE else self.everything
                e, f, la = any(x[0] for x in parts), frozenset(chars).union(*(x[1] for x in parts)), frozenset(chars).union(*(x[2] for x in parts))
            elif op is C.BRANCH:
                parts = [self.walk(x, pairs) for x in arg[1]]
                e, f, la = any(x[0] for x in parts), frozenset().union(*(x[1] for x in parts)), frozenset().union(*(x[2] for x in parts))
            elif op is C.SUBPATTERN:
                e, f, la = self.walk(arg[3], pairs)
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
                e, f, la = self.walk(arg[2], pairs)
                if arg[1] > 1:
                    pairs.update((a, b) for a in la for b in f)
                e = e or arg[0] == 0
            elif op in (C.ASSERT, C.ASSERT_NOT, C.AT, C.FAILURE):
                continue
            else:
                raise ValueError(f"no rule for {op}")
            pairs.update((a, b) for a in last for b in f)
            first = first | f if empty else first
            last = la | last if e else la
            empty = empty and e
        return empty, first, last

    def within(self, start: tuple[str, str]) -> frozenset[tuple[str, str]]:
        """All pairs that a window of this start can show, those of the macros in it included."""
        out, seen, todo = set(), set(), [start]
        while todo:
            name = todo.pop()
            if name not in seen and "." not in name:
                seen.add(name)
                out |= self.pairs[name]
                todo += self.g.uses(self.g.starts[name] if isinstance(name, tuple) else self.g.spec[name])
        return frozenset(out)


@lru_cache(maxsize=None)
def permissible(lang: str) -> frozenset[str]:
    """Ordered pairs of token classes that some production lets stand next to each other."""
    g = grammar(lang)
    a = Adjacency(g, {k: (OPEN[k], CLOSE[k]) for k in OPEN})
    pairs = {p for x in a.pairs.values() for p in x if p[0] != BEGIN and p[1] != END}
    for start in g.starts:
        if start[0]:
            empty, first, last = a.known[start]
            begin, end = OPEN[start[0]], CLOSE[start[0]]
            pairs |= {(begin, c) for c in first} | {(c, end) for c in last} | ({(begin, end)} if empty else set())
    return frozenset(x + y for x, y in pairs)
