"""Column expressions for principals, rights and grant statements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rights in the order they are written, with the bit each has here.
RIGHTS = (("Read", 1), ("Write", 2), ("Reshare", 4), ("Explore", 8))
READ, WRITE, RESHARE, EXPLORE = (bit for _, bit in RIGHTS)
GRANTABLE = READ | RESHARE | EXPLORE
# Principals whose grants do not count, and the prefix of managed groups.
SKIP_PRINCIPALS = ("dbo", "public", "guest", "sys", "information_schema")
GROUP_PREFIX = "bcdr-ia-"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rights_mask(column: Column | str) -> Column:
    """'ReadWriteReshare' to its bits; null and 'None' are no rights."""
    text = F.coalesce(_col(column), F.lit("None"))
    bits = sum((F.when(F.contains(text, F.lit(name)), bit).otherwise(0) for name, bit in RIGHTS), F.lit(0))
    return F.when(text == "None", 0).otherwise(bits)


def rights_text(mask: Column | str) -> Column:
    """Bits to 'ReadReshare'; any right implies Read, none is 'None'."""
    m = _col(mask)
    full = m.bitwiseOR(F.lit(READ))
    names = F.concat(*[F.when(full.bitwiseAND(F.lit(bit)) != 0, name).otherwise("") for name, bit in RIGHTS])
    return F.when(m == 0, "None").otherwise(names)


def principal_keys(*columns: Column | str) -> Column:
    """Every identifier a principal is known by, lower-cased."""
    return F.array_distinct(F.filter(F.array(*[F.lower(_col(c)) for c in columns]), lambda k: k.isNotNull() & (k != "")))


def principal_kind(group_id: Column | str, app_id: Column | str, is_app: Column | str, upn: Column | str, user_type: Column | str,
                   email: Column | str) -> Column:
    """Group, ServicePrincipal, User, or '' when nothing tells."""
    has = lambda c: F.coalesce(_col(c), F.lit("")) != ""
    user = has(upn) | F.coalesce(_col(user_type) == 0, F.lit(False)) | has(email)
    return (F.when(has(group_id), "Group").when(has(app_id) | F.coalesce(_col(is_app), F.lit(False)), "ServicePrincipal")
            .when(user, "User").otherwise(""))


def is_inherited(folder_role_id: Column | str, folder_role: Column | str) -> Column:
    """Access that comes from a workspace role rather than a share."""
    return _col(folder_role_id).isNotNull() | (F.coalesce(_col(folder_role).cast("string"), F.lit("")) != "")


def quote_ident(column: Column | str) -> Column:
    return F.concat(F.lit("["), F.replace(F.coalesce(_col(column), F.lit("")), F.lit("]"), F.lit("]]")), F.lit("]"))


def grant_statement() -> Column:
    """Statement for a grant row (state, permission, class, schema_name, object_name, column_name, principal)."""
    column = F.when(F.coalesce("column_name", F.lit("")) != "", F.concat(F.lit(" ("), quote_ident("column_name"), F.lit(")"))).otherwise("")
    target = (F.when(F.col("class") == "DATABASE", "")
              .when(F.col("class") == "SCHEMA", F.concat(F.lit(" ON SCHEMA::"), quote_ident("schema_name")))
              .otherwise(F.concat(F.lit(" ON "), quote_ident("schema_name"), F.lit("."), quote_ident("object_name"), column)))
    verb = F.when(F.col("state") == "DENY", "DENY ").otherwise("GRANT ")
    suffix = F.when(F.col("state") == "GRANT_WITH_GRANT_OPTION", " WITH GRANT OPTION").otherwise("")
    return F.concat(verb, "permission", target, F.lit(" TO "), quote_ident("principal"), suffix, F.lit(";"))


def is_skipped_principal(column: Column | str) -> Column:
    name = F.coalesce(_col(column), F.lit(""))
    return F.lower(name).isin(*SKIP_PRINCIPALS) | name.startswith("##")


def group_nickname(item_id: Column | str, rights: Column | str, additional: Column | str) -> Column:
    """Stable name of the access group of an item and a set of rights."""
    short = F.substring(F.lower(F.replace(_col(item_id), F.lit("-"), F.lit(""))), 1, 12)
    digest = F.substring(F.sha1(F.concat_ws("|", _col(rights), _col(additional))), 1, 6)
    return F.concat(F.lit(GROUP_PREFIX), short, F.lit("-"), digest)
