"""Parsing-expression grammars of Python, Go, TypeScript and JavaScript, and how their texts become tokens.

A token becomes one character: keywords and operators have their own, names, numbers and strings
one each. What no token matches becomes the character of an error, which no rule accepts.
"""

from __future__ import annotations

import re

from .peg import GROUP, GROUP_SIZE, Grammar

ERROR = "\x01"
NAME, NUMBER, STRING = "n", "0", "s"


def _alphabet(words: list[str], start: int = 0x100) -> dict[str, str]:
    return {w: chr(start + k) for k, w in enumerate(dict.fromkeys(words))}


# Python -------------------------------------------------------------------------------------------

_PY_WORDS = "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type".split()
_PY_OPS = "-> := ... ** // << >> <= >= == != += -= *= /= %= &= |= ^= @= **= //= <<= >>= + - * / % @ & | ^ ~ < > = , : . ;".split()
PY_TOKENS = _alphabet(_PY_WORDS + _PY_OPS) | {b: b for b in "()[]{}"}
#: What a name may go on with besides word characters: combining marks and a few others.
_MARKS = "".join(c for c in map(chr, range(0x80, 0x20000)) if ("a" + c).isidentifier() and not re.match(r"\w", c))
PY_LEX = re.compile(
    r"(?:[ \t\f]+|\\\n|\#[^\n]*)*("
    r"\n(?:[ \t\f]*(?:\#[^\n]*)?\n)*[ \t\f]*|(?:[^\W\d]|[℘℮])[\w" + _MARKS + r"]*(?![\w\"'])"
    r"|(?:[rRbBuUfFtT]{0,2})(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|\"(?!\"\")(?:[^\\\"\n]|\\.)*\"|'(?!'')(?:[^\\'\n]|\\.)*')"
    r"|(?:[^\W\d]|[℘℮])[\w" + _MARKS + r"]*"
    r"|(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.)(?:[eE][-+]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*[eE][-+]?\d(?:_?\d)*[jJ]?|\d(?:_?\d)*[jJ]|0(?:_?0)*(?!\d)|[1-9](?:_?\d)*)(?!\w)"
    r"|\*\*=|//=|<<=|>>=|\.\.\.|->|:=|\*\*|//|<<|>>|[<>=!+\-*/%&|^@]=|[-+*/%@&|^~<>=,:.;()\[\]{}]|\Z|.)",
    re.S,
)

PYTHON = r"""
Stmts <- Simple (';' Simple)* ';'?
Line <- Stmts END / Header
Header <- 'async'? 'def' NAMES brack:TypeParams? paren:Params ('->' Test)? ':' Tail / 'class' NAMES brack:TypeParams? paren:Args? ':' Tail / 'if' Named ':' Tail / 'elif' Named ':' Tail / 'else' ':' Tail / 'while' Named ':' Tail / 'async'? 'for' Targets 'in' StarList ':' Tail / 'try' ':' Tail / 'except' '*'? (Test (',' Test)* ('as' NAMES)?)? ':' Tail / 'finally' ':' Tail / 'async'? 'with' (paren:WithItems &':' / WithItem (',' WithItem)*) ':' Tail / 'match' SubjectList ':' END / 'case' Patterns ('if' Named)? ':' Tail / '@' Named END
Tail <- Stmts? END
WithItem <- Test ('as' Target)?
WithItems <- WithItem (',' WithItem)* ','?
SubjectList <- StarNamed (',' StarNamed)* ','?
Simple <- 'pass' / 'break' / 'continue' / 'return' StarList? / 'raise' (Test ('from' Test)?)? / 'global' NAMES (',' NAMES)* / 'nonlocal' NAMES (',' NAMES)* / 'del' Targets / 'assert' Test (',' Test)? / Import / 'type' NAMES brack:TypeParams? '=' Test / Target ':' Test ('=' Value)? / Target AUGMENT Value / (Targets '=' !'=')+ Value / Yield / StarList
Value <- Yield / StarList
Yield <- 'yield' ('from' Test / StarList)?
Import <- 'import' Dotted ('as' NAMES)? (',' Dotted ('as' NAMES)?)* / 'from' ('.' / '...')* Dotted? 'import' ('*' / paren:ImportNames / ImportName (',' ImportName)*)
ImportName <- NAMES ('as' NAMES)?
ImportNames <- ImportName (',' ImportName)* ','?
Dotted <- NAMES ('.' NAMES)*
Targets <- StarTarget (',' StarTarget)* ','?
StarTarget <- '*'? Target
Target <- Atom (Trailer &Trailer)* ('.' NAMES / brack:Subscript) / NAMES !('.') / paren:TargetGroup / brack:TargetGroup
TargetGroup <- Targets? END
StarList <- StarTest (',' StarTest)* ','?
StarTest <- '*' Arith / Test
StarNamed <- '*' Arith / Named
Named <- NAMES ':=' Test / Test
Test <- Lambda / Or ('if' Or 'else' Test)?
Lambda <- 'lambda' LambdaParams? ':' Test
LambdaParams <- LambdaParam (',' LambdaParam)* ','?
LambdaParam <- '**' NAMES / '*' NAMES? / '/' / NAMES ('=' Test)?
Or <- Not (('or' / 'and') Not)*
Not <- 'not' Not / Compare
Compare <- Arith (COMPARE Arith / 'not' 'in' Arith / 'in' Arith / 'is' 'not'? Arith)*
Arith <- Unary (BINARY Unary)*
Unary <- SIGN* 'await'? Atom Trailer* ('**' Unary)?
Trailer <- '.' NAMES / paren:Args / brack:Subscript
Atom <- NAMES / NUMBER / STRING+ / '...' / paren:Paren / brack:List / brace:Set
Args <- (Arg (',' Arg)* ','?)? END
Arg <- '**' Test / '*' Test / NAMES '=' !'=' Test / Named Comp?
Comp <- ('async'? 'for' Targets 'in' Or ('if' (Lambda / NAMES ':=' Test / Or))*)+
Paren <- END / Yield END / StarNamed Comp END / StarNamed (',' StarNamed)* ','? END
List <- END / StarNamed Comp END / StarNamed (',' StarNamed)* ','? END
Subscript <- Slice (',' Slice)* ','? END
Slice <- Named? ':' Test? (':' Test?)? / StarNamed
Set <- END / Pair Comp END / Pair (',' Pair)* ','? END / StarNamed Comp END / StarNamed (',' StarNamed)* ','? END
Pair <- '**' Arith / Test ':' Test
Params <- (Param (',' Param)* ','?)? END
Param <- '**' NAMES (':' Test)? / '*' NAMES (':' StarTest)? / '*' &',' / '/' / NAMES (':' Test)? ('=' Test)?
TypeParams <- ('*' / '**')? NAMES (':' Test)? ('=' Test)? (',' ('*' / '**')? NAMES (':' Test)? ('=' Test)?)* ','?
Patterns <- Pattern (',' Pattern)* ','?
PatternGroup <- (Pattern (',' Pattern)* ','?)? END
Pattern <- '*' NAMES / OnePattern ('|' OnePattern)* ('as' NAMES)?
OnePattern <- SIGN? NUMBER (SIGN NUMBER)? / STRING+ / NAMES ('.' NAMES)* paren:PatternArgs? / paren:PatternGroup / brack:PatternGroup / brace:PatternMap
PatternArgs <- ((NAMES '=')? Pattern (',' (NAMES '=')? Pattern)* ','?)? END
PatternMap <- (('**' NAMES / OnePattern ':' Pattern) (',' ('**' NAMES / OnePattern ':' Pattern))* ','?)? END
"""
_P = PY_TOKENS
PY_CLASSES = {
    "NAMES": NAME + "".join(_P[w] for w in ("match", "case", "type")),
    "NUMBER": NUMBER, "STRING": STRING,
    "AUGMENT": "".join(_P[w] for w in "+= -= *= /= %= &= |= ^= @= **= //= <<= >>=".split()),
    "COMPARE": "".join(_P[w] for w in "< > <= >= == !=".split()),
    "BINARY": "".join(_P[w] for w in "+ - * / // % @ & | ^ << >>".split()),
    "SIGN": "".join(_P[w] for w in "+ - ~".split()),
}
PY_GROUPS = {"paren": ["Args", "Paren", "Params", "ImportNames", "WithItems", "TargetGroup", "PatternGroup", "PatternArgs"], "brack": ["List", "Subscript", "TargetGroup", "TypeParams", "PatternGroup"], "brace": ["Set", "PatternMap"]}

#: How the lines of a block follow each other; a block that is itself right is B, one of cases C.
PYTHON_BLOCK = r"""
Block <- Statement+
Statement <- 's' / '@'* ('d' / 'c') 'B' / 'i' 'B' ('l' 'B')* ('e' 'B')? / 'f' 'B' ('e' 'B')? / 'h' 'B' / 't' 'B' ('x' 'B' ('x' 'B')* ('e' 'B')? ('y' 'B')? / 'y' 'B') / 'm' 'C'
Cases <- ('k' 'B')+
"""
PY_KINDS = {"def": "d", "class": "c", "if": "i", "elif": "l", "else": "e", "while": "f", "for": "f", "try": "t", "except": "x", "finally": "y", "with": "h", "match": "m", "case": "k", "@": "@"}

# Go -----------------------------------------------------------------------------------------------

_GO_WORDS = "break default func interface select case defer go map struct chan else goto package switch const fallthrough if range type continue for import return var".split()
_GO_OPS = "<<= >>= &^= &^ << >> += -= *= /= %= &= |= ^= && || <- ++ -- == != <= >= := ... + - * / % & | ^ < > = ! , ; . : ~".split()
GO_TOKENS = _alphabet(_GO_WORDS + _GO_OPS) | {b: b for b in "()[]{};"}
GO_LEX = re.compile(
    r"(?:[ \t\r]+|//[^\n]*|/\*(?:[^*\n]|\*(?!/))*\*/)*("
    r"\n|/\*(?:[^*]|\*(?!/))*\*/|[^\W\d]\w*|`[^`]*`|\"(?:[^\\\"\n]|\\[abfnrtv\\\"]|\\[0-7]{3}|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8})*\"|'(?:[^\\'\n]|\\[abfnrtv\\']|\\[0-7]{3}|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8})'"
    r"|(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][-+]?\d+)?|0[oO][0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][-+]?\d+)?)i?(?![\w])"
    r"|<<=|>>=|&\^=|\.\.\.|&\^|<<|>>|&&|\|\||<-|\+\+|--|:=|[=!<>+\-*/%&|^]=|[-+*/%&|^<>=!,;.:~()\[\]{}]|\Z|.)",
    re.S,
)
_GO = r"""
File <- 'package' NAME ';' (Import ';')* (Top ';')* END
Import <- 'import' (paren:ImportSpecs / ImportSpec)
ImportSpec <- ('.' / NAME)? STRING
ImportSpecs <- (ImportSpec ';')* ImportSpec? END
Top <- 'func' paren:Params NAME paren:Params Result? brace:Block? / 'func' NAME brack:TypeParams? paren:Params Result? brace:Block? / Decl
Decl <- 'const' (paren:ConstSpecs / ConstSpec) / 'var' (paren:VarSpecs / VarSpec) / 'type' (paren:TypeSpecs / TypeSpec)
ConstSpec <- Names (Type? '=' Exprs)?
ConstSpecs <- (ConstSpec ';')* ConstSpec? END
VarSpec <- Names ('=' Exprs / Type ('=' Exprs)?)
VarSpecs <- (VarSpec ';')* VarSpec? END
TypeSpec <- NAME brack:TypeParams '='? Type / NAME '='? Type
TypeSpecs <- (TypeSpec ';')* TypeSpec? END
Names <- NAME (',' NAME)*
Result <- paren:Params / Type
Params <- (Param (',' Param)* ','?)? END
Param <- NAME '...'? Type / '...'? Type
Type <- NAME ('.' NAME)? brack:TypeArgs? / '*' Type / brack:Empty Type / brack:Length Type / 'map' brack:TypeArgs Type / 'chan' '<-'? Type / '<-' 'chan' Type / 'func' paren:Params Result? / 'struct' brace:Struct / 'interface' brace:Interface / paren:TypeOnly
TypeOnly <- Type END
TypeWord <- 'type' END
TypeArgs <- Type (',' Type)* ','? END
TypeParams <- Names Constraint (',' Names Constraint)* ','? END
Constraint <- '~'? Type ('|' '~'? Type)*
Empty <- END
Length <- ('...' / Expr) END
Index <- Expr ','? END / Expr? ':' Expr? (':' Expr)? END
Struct <- (Field ';')* Field? END
Field <- (Names Type / '*'? NAME ('.' NAME)? brack:TypeArgs?) STRING?
Interface <- (Element ';')* Element? END
Element <- NAME paren:Params Result? / Constraint
Literal <- (Keyed (',' Keyed)* ','?)? END
Keyed <- (Value ':')? Value
Value <- brace:Literal / Expr
Exprs <- Expr (',' Expr)*
Args <- ((Expr / Type) (',' (Expr / Type))* '...'? ','?)? END
ParenExpr <- Expr END
Block <- Statements END
Statements <- (Statement? ';')* Statement?
Statement <- Decl / NAME ':' !'=' Statement? / ('go' / 'defer') Expr / 'return' Exprs? / ('break' / 'continue') NAME? / 'goto' NAME / 'fallthrough' / brace:Block / If / 'switch' Switch / 'select' brace:Select / 'for' For / SimpleS
If <- 'if' (SimpleH? ';')? ExprH brace:Block ('else' (If / brace:Block))?
Switch <- ((SimpleH? ';')? SimpleH? brace:Cases)
For <- brace:Block / (ExprsH (':=' / '='))? 'range' ExprH brace:Block / SimpleH? ';' ExprH? ';' SimpleH? brace:Block / ExprH brace:Block
Cases <- (('case' (Expr / Type) (',' (Expr / Type))* / 'default') ':' Statements)* END
Select <- (('case' SimpleS / 'default') ':' Statements)* END
SimpleS <- Exprs ((':=' / ASSIGN) Exprs / '++' / '--' / '<-' Expr)?
SimpleH <- ExprsH ((':=' / ASSIGN) ExprsH / '++' / '--' / '<-' ExprH)?
ExprsH <- ExprH (',' ExprH)*
"""
_GO_EXPR = r"""
Expr@ <- Unary@ (BINARY Unary@)*
Unary@ <- UNARY* Primary@
Primary@ <- Operand@ ('.' NAME / '.' paren:TypeOnly / '.' paren:TypeWord / brack:Index / brack:TypeArgs / paren:Args)*
Operand@ <- NUMBER / STRING / 'func' paren:Params (Result &brace:Block)? brace:Block / brack:Empty Type (brace:Literal / paren:Args) / brack:Length Type brace:Literal / ('map' brack:TypeArgs Type) (brace:Literal / paren:Args) / 'struct' brace:Struct brace:Literal / ('chan' '<-'? Type / 'interface' brace:Interface / 'func' paren:Params Result?) paren:Args / %NAME / paren:ParenExpr / paren:TypeOnly
"""
GO = _GO + _GO_EXPR.replace("@", "").replace("%NAME", "NAME ('.' NAME)? brack:TypeArgs? brace:Literal / NAME") + _GO_EXPR.replace("@", "H").replace("%NAME", "NAME")
_G = GO_TOKENS
GO_CLASSES = {
    "NAME": NAME, "NUMBER": NUMBER, "STRING": STRING,
    "ASSIGN": "".join(_G[w] for w in "= += -= *= /= %= &= |= ^= <<= >>= &^=".split()),
    "BINARY": "".join(_G[w] for w in "|| && == != < <= > >= + - | ^ * / % << >> & &^".split()),
    "UNARY": "".join(_G[w] for w in "+ - ! ^ * & <-".split()),
}
GO_GROUPS = {"paren": ["Args", "ParenExpr", "Params", "TypeOnly", "TypeWord", "ImportSpecs", "ConstSpecs", "VarSpecs", "TypeSpecs"], "brack": ["Empty", "Length", "Index", "TypeArgs", "TypeParams"], "brace": ["Block", "Literal", "Struct", "Interface", "Cases", "Select"]}
#: After these a line break ends the statement.
GO_ENDS = NAME + NUMBER + STRING + ")]}" + "".join(_G[w] for w in ("break", "continue", "fallthrough", "return", "++", "--"))

# TypeScript and JavaScript ------------------------------------------------------------------------

_JS_WORDS = "break case catch class const continue debugger default delete do else enum export extends finally for function if import in instanceof new return super switch throw try typeof var void while with yield null true false this let".split()
_JS_NAMES = "async await of get set static type interface as from is keyof readonly unique infer declare namespace module abstract public private protected override implements satisfies asserts accessor global out".split()
_JS_OPS = ">= => === !== == != <= && || ?? ?. ... ++ -- ** += -= *= /= %= **= <<= &= |= ^= &&= ||= ??= << + - * / % & | ^ ~ ! < > = ? : , ; . @ #".split()
JS_TOKENS = _alphabet(_JS_WORDS + _JS_NAMES + _JS_OPS) | {b: b for b in "()[]{};"} | {"template": "t", "template(": "\x02", ")template": "\x03", "regex": "r", "markup": "\x04"}
JS_LEX = re.compile(
    r"(?:[ \t\f\v\xa0﻿]+|//[^\n]*|/\*(?:[^*\n]|\*(?!/))*\*/)*("
    r"\n(?:\s*(?://[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)?\n)*|/\*(?:[^*]|\*(?!/))*\*/|\#?[^\W\d](?:[\w$]|\\u[0-9a-fA-F]{4})*|\#?\$[\w$]*"
    r"|\"(?:[^\\\"\n]|\\.)*\"|'(?:[^\\'\n]|\\.)*'"
    r"|(?:0[xX][0-9a-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:(?:0|[1-9][\d_]*)(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][-+]?\d[\d_]*)?n?)(?![\w$])"
    r"|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|\.\.\.|\?\.(?!\d)|\?\?|&&|\|\||\+\+|--|\*\*|<<|[=!<>+\-*/%&|^]=|[-+*/%&|^~!<>=?:,;.@()\[\]{}`\#]|\Z|.)",
    re.S,
)
_JS = r"""
Program <- TopStatement* END
TopStatement <- Import / Export / Statement
Import <- 'import' (STRING / 'type'? Clause 'from' STRING) ('with' brace:Object)? Eos / 'import' 'type'? NAMES '=' Expr Eos
Clause <- NAMES (',' (Space / brace:Specs))? / Space / brace:Specs
Space <- '*' 'as' NAMES
Specs <- (Spec (',' Spec)* ','?)? END
Spec <- 'type' !(',' / END) !('as' (',' / END)) (WORDS / STRING) ('as' (WORDS / STRING))? / (WORDS / STRING) ('as' (WORDS / STRING))?
Export <- Decorator+ 'export' ('default' Abstract? DefaultClass / Abstract? Class) / 'export' ('default' (Function / Class / DefaultFunction / Abstract? DefaultClass / Typed / !('function' / 'class') Assign Eos) / 'type'? '*' ('as' (WORDS / STRING))? 'from' STRING Eos / 'type'? brace:Specs ('from' STRING)? Eos / Variables Eos / Function / Class / Typed / Assignment)
DefaultFunction <- 'async'? 'function' '*'? TypeParams? paren:Params Annotation? (brace:Block / Bodiless)
DefaultClass <- Decorator* 'class' (NAMES TypeParams? Heritage brace:ClassBody / TypeParams? Heritage brace:ClassBody)
Abstract <- %TS 'abstract'
Assignment <- %TS ('=' Expr Eos / 'as' 'namespace' NAMES Eos)
Statement <- brace:Block / ';' / Typed / Variables Eos / Function / Class / 'if' paren:ExprOnly Statement ('else' Statement)? / 'for' 'await'? paren:ForHead Statement / 'while' paren:ExprOnly Statement / 'do' Statement 'while' paren:ExprOnly ';'? / 'switch' paren:ExprOnly brace:Switch / Try / 'return' (NONL Expr)? Eos / 'throw' NONL Expr Eos / ('break' / 'continue') (NONL NAMES)? Eos / 'debugger' Eos / NAMES ':' Statement / !('function' / 'class' / BRACE) Expr Eos
Eos <- ';' / NL
Block <- Statement* END
Space2 <- (AmbientVariable / TopStatement)* END
AmbientVariable <- %TS 'export'? ('const' / 'let' / 'var') NAMES ':' Type Eos
Try <- 'try' brace:Block ('catch' paren:Catch? brace:Block ('finally' brace:Block)? / 'finally' brace:Block)
Catch <- Binding Annotation? END
Switch <- (('case' Expr / 'default') ':' Statement*)* END
ForHead <- ('var' / 'let' / 'const') Binding ('of' / 'in') Expr END / LeftSide ('of' / 'in') Expr END / (Loose / Expr)? ';' Expr? ';' Expr? END
Loose <- ('var' / 'let' / 'const') Binding Annotation? ('=' Assign)? (',' Binding Annotation? ('=' Assign)?)*
Variables <- 'const' !'enum' Constant (',' Constant)* / ('var' / 'let') Variable (',' Variable)*
Constant <- Binding Annotation? '=' Assign
Variable <- NAMES '!'? Annotation? ('=' Assign)? / Binding Annotation? '=' Assign
Binding <- NAMES / brack:ArrayPattern / brace:ObjectPattern
Element <- Binding ('=' Assign)?
ArrayPattern <- ','* ('...'? Element (','+ '...'? Element)* ','*)? END
ObjectPattern <- (PatternPart (',' PatternPart)* ','?)? END
PatternPart <- '...' Binding / Key ':' Element / NAMES ('=' Assign)?
Function <- 'async'? 'function' '*'? NAMES TypeParams? paren:Params Annotation? (brace:Block / Bodiless)
Bodiless <- %TS Eos
Class <- Decorator* 'class' NAMES TypeParams? Heritage brace:ClassBody
Heritage <- ('extends' LeftSide TypeArgs?)? Implements?
Implements <- %TS 'implements' Type (',' Type)*
Decorator <- '@' (NAMES ('.' WORDS)* paren:Args? / paren:ExprOnly)
ClassBody <- Member* END
Member <- ';' / 'static' brace:Block / Decorator* Modifier* (Signature / Method / Field)
Modifier <- MODIFIERS &(Key / '*' / BRACK)
Signature <- %TS brack:IndexSignature '?'? ':' Type Eos
Method <- '*'? Key Optional? TypeParams? paren:Params Annotation? (brace:Block / Bodiless)
Optional <- %TS ('?' / '!')
Field <- Key Optional? Annotation? ('=' Assign)? Eos
Key <- WORDS / STRING / NUMBER / brack:ExprOnly
Object <- (Property (',' Property)* ','?)? END
Property <- '...' Assign / Key ':' Assign / Modifier* '*'? Key TypeParams? paren:Params Annotation? brace:Block / NAMES ('=' Assign)?
Array <- ','* ('...'? Assign (','+ '...'? Assign)* ','*)? END
Params <- (Param (',' Param)* ','?)? END
Param <- Decorator* (MODIFIERS &(NAMES / BRACE / BRACK))* '...'? ('this' / Binding) Optional? Annotation? ('=' Assign)?
Args <- ('...'? Assign (',' '...'? Assign)* ','?)? END
ExprOnly <- Expr END
Container <- '...'? Expr? END
Expr <- Assign (',' Assign)*
Assign <- Arrow / 'yield' ('*' Assign / NONL Assign / ) / LeftSide (ASSIGN / '>' '>'? '>=') Assign / Conditional
Arrow <- 'async'? (NAMES / TypeParams? paren:Params Annotation?) '=>' (brace:Block / !BRACE Assign)
Conditional <- Binary ('?' Assign ':' Assign)?
Binary <- Unary (BINARY Unary / '>' '>'? '>'? Unary / Cast)*
Cast <- %TS ('as' 'const' / ('as' / 'satisfies') Type)
Unary <- ('await' / UNARY) Unary / OldCast / Postfix
OldCast <- %TS '<' Type '>' Unary
Postfix <- LeftSide (NONL ('++' / '--'))?
LeftSide <- ('new' New / Primary) Suffix*
New <- '.' NAMES / 'new' New / Primary (Dot / brack:ExprOnly)* TypeArgs? paren:Args?
Dot <- '.' WORDS
Suffix <- '.' WORDS / '?.' (WORDS / brack:ExprOnly / TypeArgs? paren:Args) / brack:ExprOnly / paren:Args / TypeArgs (paren:Args / Template) / Template / NotNull
NotNull <- %TS NONL '!'
Template <- 'template' / 'template(' subst:ExprOnly+ ')template'
Primary <- 'async'? 'function' '*'? NAMES? TypeParams? paren:Params Annotation? brace:Block / Decorator* 'class' NAMES? TypeParams? Heritage brace:ClassBody / NAMES / ATOM / NUMBER / STRING / 'regex' / Template / 'markup' subst:Container* / brack:Array / brace:Object / paren:ExprOnly / 'import' (paren:Args / '.' NAMES)
Annotation <- %TS ':' Return
Return <- 'asserts' (NAMES / 'this') ('is' Type)? / (NAMES / 'this') 'is' Type / Type
TypeParams <- %TS '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam <- ('const' / 'in' / 'out')* NAMES ('extends' Type)? ('=' Type)?
TypeArgs <- %TS '<' Type (',' Type)* ','? '>'
Type <- 'abstract'? 'new'? TypeParams? paren:Params '=>' Return / Union ('extends' Union '?' Type ':' Type)?
Union <- '|'? Intersection ('|' Intersection)*
Intersection <- '&'? TypeUnary ('&' TypeUnary)*
TypeUnary <- ('keyof' / 'unique' / 'readonly' / 'infer') TypeUnary / TypePrimary (NONL brack:Tuple)*
TypePrimary <- 'typeof' (NAMES / 'this' / 'import' paren:Args) ('.' WORDS)* TypeArgs? / NAMES ('.' WORDS)* TypeArgs? / STRING / '-'? NUMBER / ATOM / 'void' / Template / brack:Tuple / brace:TypeBody / paren:TypeOnly / 'import' paren:Args ('.' WORDS)* TypeArgs?
TypeOnly <- Type END
Tuple <- (TuplePart (',' TuplePart)* ','?)? END
TuplePart <- '...'? NAMES '?'? ':' Type / '...'? Type '?'?
IndexSignature <- NAMES ':' Type END / NAMES 'in' Type ('as' Type)? END
TypeBody <- (TypeMember (';' / ',' / NL))* END
TypeMember <- ('+' / '-')? ('readonly' &(Key / BRACK))? brack:IndexSignature ('+' / '-')? '?'? ':' Type / 'new'? TypeParams? paren:Params Annotation? / Modifier* Key '?'? (TypeParams? paren:Params Annotation? / Annotation)?
EnumBody <- (EnumMember (',' EnumMember)* ','?)? END
EnumMember <- (WORDS / STRING) ('=' Assign)?
Typed <- %TS ('interface' NAMES TypeParams? ('extends' Type (',' Type)*)? brace:TypeBody / 'type' NAMES TypeParams? '=' Type Eos / 'const'? 'enum' NAMES brace:EnumBody / ('namespace' / 'module') (NAMES ('.' WORDS)* / STRING) brace:Space2 / Decorator* 'abstract' Class / 'declare' ('global' brace:Space2 / ('module' STRING) (brace:Space2 / Eos) / Loose Eos / Function / Class / Typed))
"""
TYPESCRIPT = _JS.replace("%TS ", "")
JAVASCRIPT = _JS.replace("%TS ", "NEVER ")
_J = JS_TOKENS
_JS_NAMES_SET = NAME + "".join(_J[w] for w in _JS_NAMES)
JS_CLASSES = {
    "NAMES": _JS_NAMES_SET,
    "WORDS": _JS_NAMES_SET + "".join(_J[w] for w in _JS_WORDS),
    "ATOM": "".join(_J[w] for w in "null true false this super".split()),
    "NUMBER": NUMBER, "STRING": STRING,
    "MODIFIERS": "".join(_J[w] for w in "static async get set accessor public private protected readonly override abstract declare".split()),
    "ASSIGN": "".join(_J[w] for w in "= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split()),
    "BINARY": "".join(_J[w] for w in "=== !== == != <= >= && || ?? ** << + - * / % & | ^ < in instanceof".split()),
    "UNARY": "".join(_J[w] for w in "+ - ! ~ ++ -- typeof void delete".split()),
    "BRACE": "".join(chr(GROUP + 2 * GROUP_SIZE + k) for k in range(GROUP_SIZE)),
    "BRACK": "".join(chr(GROUP + 1 * GROUP_SIZE + k) for k in range(GROUP_SIZE)),
}
JS_GROUPS = {"paren": ["Args", "ExprOnly", "Params", "ForHead", "Catch", "TypeOnly"], "brack": ["Array", "ExprOnly", "ArrayPattern", "Tuple", "IndexSignature"], "brace": ["Block", "Object", "ObjectPattern", "ClassBody", "TypeBody", "Specs", "Switch", "EnumBody", "Container", "Space2"], "subst": ["ExprOnly", "Container"]}


def python() -> Grammar:
    return Grammar(PYTHON, PY_TOKENS, PY_CLASSES, PY_GROUPS)


def python_block() -> Grammar:
    return Grammar(PYTHON_BLOCK, {c: c for c in "s@dcilefhtxymkBC"}, {}, {})


def go() -> Grammar:
    return Grammar(GO, GO_TOKENS, GO_CLASSES, GO_GROUPS)


def typescript() -> Grammar:
    return Grammar(TYPESCRIPT, JS_TOKENS, JS_CLASSES, JS_GROUPS)


def javascript() -> Grammar:
    return Grammar(JAVASCRIPT, JS_TOKENS, JS_CLASSES, JS_GROUPS)
