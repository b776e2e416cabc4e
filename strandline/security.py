"""Roles and what they may do."""

from __future__ import annotations

SYSTEM, DBA, SERVICE, USER, ANONYMOUS = "system", "dba", "service", "user", "anonymous"
ROLES = (SYSTEM, DBA, SERVICE, USER, ANONYMOUS)
ADMINS = (SYSTEM, DBA)
STAFF = (SYSTEM, DBA, SERVICE)
#: Whom a role may act for.
ACTS_FOR = {SYSTEM: ROLES, DBA: (SERVICE, USER, ANONYMOUS), SERVICE: (USER, ANONYMOUS), USER: (), ANONYMOUS: ()}
#: Who may create and alter tables of a kind.
CREATES = {"USER": (*STAFF, USER), "STREAM": (*STAFF, USER), "SHARED": STAFF, "SYSTEM": (SYSTEM,)}
ALTERS = {"USER": (*STAFF, USER), "STREAM": (*STAFF, USER), "SHARED": STAFF, "SYSTEM": ADMINS}
#: Columns that only administrators see.
MASKED = ("credentials", "password_hash")


class AccessDenied(PermissionError):
    pass


def require(allowed: bool, what: str) -> None:
    if not allowed:
        raise AccessDenied(what)


def reads_all_users(role: str) -> bool:
    """Rows of all users, not just the caller's."""
    return role in STAFF


def may_read(kind: str, access: str, role: str) -> bool:
    if kind == "SYSTEM":
        return role in ADMINS
    if kind == "SHARED":
        return access == "public" or role in (ADMINS if access == "dba" else STAFF)
    return role != ANONYMOUS


def may_write(kind: str, access: str, role: str) -> bool:
    if kind == "SYSTEM":
        return False
    if kind == "SHARED":
        return role in (ADMINS if access == "dba" else STAFF)
    return role != ANONYMOUS


def may_act_for(role: str, target: str) -> bool:
    return target in ACTS_FOR[role]
