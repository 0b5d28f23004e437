"""What can go wrong, by kind."""


class LakeError(Exception):
    """Any failure of this library."""


class DatabaseExists(LakeError):
    pass


class DatabaseMissing(LakeError):
    pass


class DatabaseNotEmpty(LakeError):
    pass


class TableExists(LakeError):
    pass


class TableMissing(LakeError):
    pass


class PartitionMissing(LakeError):
    pass


class BranchExists(LakeError):
    pass


class BranchMissing(LakeError):
    pass


class SnapshotMissing(LakeError):
    pass


class SchemaError(LakeError):
    pass


class InvalidName(LakeError, ValueError):
    pass


class CommitConflict(LakeError):
    """Another commit took away, or changed, what this one builds on."""


class Unsupported(LakeError):
    pass
