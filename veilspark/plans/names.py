"""Which functions a statement may call and what they give away."""

from __future__ import annotations

REDUCING = frozenset(
    "count sum avg mean stddev stddev_pop stddev_samp variance var_pop var_samp corr covar_pop covar_samp regr_avgx regr_avgy regr_count "
    "regr_intercept regr_r2 regr_slope regr_sxx regr_sxy regr_syy bool_and bool_or every".split()
)
NOT_VALUES = frozenset({"count", "regr_count"})
RANKING = frozenset("row_number rank dense_rank percent_rank cume_dist ntile".split())
PURE = frozenset("abs round ceil ceiling floor sign signum mod div power pow sqrt cbrt exp ln log greatest least nullif coalesce to_char to_number".split())
TEXT = frozenset(
    "length char_length character_length octet_length lower upper initcap substr substring left right trim btrim ltrim rtrim replace translate "
    "overlay concat concat_ws format_string repeat reverse ascii chr md5 encode decode like_escape".split()
)
CONTEXT = frozenset("now current_timestamp current_date localtimestamp current_database current_catalog current_schema current_user session_user user version".split())
JSON = frozenset("get_json_object variant_get try_variant_get parse_json try_parse_json".split())
DATES = frozenset({"date_trunc"})
GROUPS = frozenset("grouping grouping_id".split())
#: Predicates that the grammar turns into calls.
PREDICATES = frozenset({"between"})

TRUSTED = REDUCING | RANKING | PURE | TEXT | CONTEXT | JSON | DATES | GROUPS | PREDICATES

#: Aggregates that give back values of their input and are never released.
VALUE_RETURNING = frozenset(
    "min max mode percentile_disc percentile_cont first first_value last last_value nth_value lag lead string_agg listagg array_agg collect_list collect_set "
    "any_value max_by min_by percentile approx_percentile percentile_approx median histogram_numeric".split()
)

#: Functions that the grammar turns into expressions by itself.
VALUE_CLASSES = frozenset("First Last AnyValue NthValue Lag Lead Mode PercentileCont PercentileDisc Percentile ApproximatePercentile CollectList CollectSet".split())

# ----------------------------------------------- class names in analyzed plans
REDUCING_CLASSES = frozenset(
    "Count Sum Average StddevPop StddevSamp VariancePop VarianceSamp Corr CovPopulation CovSample RegrAvgX RegrAvgY RegrCount RegrIntercept RegrR2 RegrSlope "
    "RegrSXX RegrSXY RegrSYY BoolAnd BoolOr".split()
)
RANKING_CLASSES = frozenset("RowNumber Rank DenseRank PercentRank CumeDist NTile".split())
CONTEXT_CLASSES = frozenset("Now CurrentTimestamp CurrentDate LocalTimestamp CurrentDatabase CurrentCatalog CurrentUser SparkVersion CurrentTimeZone".split())
OPERATOR_CLASSES = frozenset(
    "Add Subtract Multiply Divide IntegralDivide Remainder Pmod UnaryMinus UnaryPositive And Or Not EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan "
    "LessThanOrEqual IsNull IsNotNull In Between BitwiseAnd BitwiseOr BitwiseXor BitwiseNot".split()
)
PURE_CLASSES = frozenset("Abs Round BRound Ceil Floor RoundCeil RoundFloor Signum Pow Sqrt Cbrt Exp Log Logarithm Greatest Least NullIf ToCharacter ToNumber CheckOverflow".split())
CAST_CLASSES = frozenset("Cast Collate UpCast AnsiCast PromotePrecision KnownNotNull NormalizeNaNAndZero".split())
JSON_CLASSES = frozenset({"GetJsonObject", "VariantGet"})
#: What lineage may see through: results depend on these inputs alone.
CLOSED_CLASSES = (
    OPERATOR_CLASSES | PURE_CLASSES | CAST_CLASSES | JSON_CLASSES
    | frozenset(
        "Alias AttributeReference Literal Coalesce CaseWhen If CreateArray GetArrayItem GetStructField Length OctetLength Lower Upper InitCap Substring Left Right "
        "StringTrim StringTrimLeft StringTrimRight StringTrimBoth StringReplace StringTranslate Overlay Concat ConcatWs FormatString StringRepeat Reverse Ascii Chr Md5 "
        "Encode Decode StringEncode StringDecode TruncTimestamp TruncDate Like AggregateExpression Mixed With CommonExpressionDef CommonExpressionRef TypedNullLiteral".split()
    )
    | REDUCING_CLASSES
)

#: Expressions of parsed trees that name nothing and call nothing by themselves.
PARSED_CLASSES = frozenset(
    "UnresolvedAttribute UnresolvedStar UnresolvedStarExceptOrReplace UnresolvedFunction UnresolvedAlias UnresolvedExtractValue UnresolvedOrdinal UnresolvedHaving "
    "MultiAlias OuterReference Exists ListQuery ScalarSubquery LateralSubquery InSubquery SortOrder Ascending Descending NullsFirst NullsLast "
    "WindowExpression UnresolvedWindowExpression WindowSpecDefinition WindowSpecReference SpecifiedWindowFrame UnspecifiedFrame UnboundedPreceding UnboundedFollowing CurrentRow RowFrame RangeFrame "
    "Rollup Cube GroupingSets GroupingAnalytics Grouping GroupingID NaturalJoin UsingJoin ILike RLike LikeAll LikeAny NotLikeAll NotLikeAny Between "
    "CreateNamedStruct CreateStruct CreateMap NamePlaceholder UnresolvedCollation UnresolvedTypedNullLiteral CurrentTime PipeExpression "
    "MakeInterval MakeYMInterval MakeDTInterval DatetimeAdd TimestampAdd TimestampDiff Year Month DayOfMonth Hour Minute Second Quarter".split()
)
#: Expressions over masked columns that raise no error, or one whose text holds no value.
QUIET_CLASSES = (
    RANKING_CLASSES | CONTEXT_CLASSES | (REDUCING_CLASSES - {"Sum"})
    | frozenset(
        "And Or Not EqualTo EqualNullSafe GreaterThan GreaterThanOrEqual LessThan LessThanOrEqual IsNull IsNotNull IsNaN In InSet Between Coalesce CaseWhen If NullIf Greatest Least Mixed With "
        "CommonExpressionDef CommonExpressionRef Alias AttributeReference OuterReference Literal TypedNullLiteral Sum AggregateExpression WindowExpression WindowSpecDefinition SpecifiedWindowFrame SortOrder "
        "ScalarSubquery LateralSubquery Exists ListQuery InSubquery Length OctetLength Lower Upper InitCap Substring Left Right StringTrim StringTrimLeft StringTrimRight StringTrimBoth StringReplace "
        "StringTranslate Overlay Concat ConcatWs Reverse Ascii Chr Md5 StartsWith EndsWith Contains BitwiseAnd BitwiseOr BitwiseXor BitwiseNot Round BRound Ceil Floor RoundCeil RoundFloor Signum Pow Sqrt Cbrt "
        "Exp Log Logarithm TruncTimestamp TruncDate Year Month DayOfMonth Hour Minute Second Quarter TimestampDiff GetJsonObject CreateArray CreateNamedStruct CreateStruct GetStructField NamePlaceholder "
        "Collate KnownNotNull NormalizeNaNAndZero PromotePrecision Rollup Cube GroupingSets Grouping GroupingID StringRepeat First Last AnyValue Min Max Lag Lead NthValue Mode".split()
    )
)
#: Those whose first argument alone may be masked: the others are formats, patterns or places, which errors quote.
QUIET_FIRST_CLASSES = frozenset("Like ILike RLike LikeAll LikeAny NotLikeAll NotLikeAny Encode Decode StringEncode StringDecode ToCharacter GetArrayItem".split())
#: Those whose arguments may be masked but for the first, a format.
QUIET_REST_CLASSES = frozenset({"FormatString"})
#: Arithmetic, which is quiet over types whose errors hold no value.
ARITHMETIC_CLASSES = frozenset("Add Subtract Multiply Divide IntegralDivide Remainder Pmod UnaryMinus UnaryPositive Abs".split())
#: Readers that are quiet where a bad value gives NULL.
TRYING_CLASSES = frozenset({"ParseJson", "VariantGet"})

#: Functions that look into trees, files or the machine, whatever name they are called by.
FORBIDDEN_CLASSES = frozenset(
    "CallMethodViaReflection TryReflect InputFileName InputFileBlockStart InputFileBlockLength PythonUDF PythonUDAF ScalaUDF ScalaUDAF HiveSimpleUDF HiveGenericUDF HiveGenericUDTF "
    "UserDefinedGenerator PythonUDTF UnresolvedPolymorphicPythonUDTF ApplyFunctionExpression V2Aggregator CurrentCatalogSchema SchemaOfJson RaiseError AssertTrue".split()
)

YEAR_OR_COARSER = frozenset("year yyyy yy decade century millennium".split())
DAY_TO_QUARTER = frozenset("day dd week month mon mm quarter".split())
