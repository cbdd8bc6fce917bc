import pytest

from clauseloom.sources import model as M


def failing(*errors, reply='```json\n{"a": 1}\n```'):
    left = list(errors)

    def call(payload):
        if left:
            e = left.pop(0)
            if isinstance(e, str):
                return e
            raise e
        return reply

    return call


def test_each_kind_of_failure_has_its_own_budget():
    waits = []
    mixed = [ConnectionError()] * 11 + [TimeoutError()] * 2 + ["no json"] * 3
    assert M.ask(failing(*mixed), "x", sleep=waits.append) == {"a": 1}
    assert len(waits) == 16 and waits[:3] == [1, 2, 4] and max(waits) == M.LONGEST_WAIT
    for kind, n in ((ConnectionError, 12), (TimeoutError, 3)):
        with pytest.raises(kind):
            M.ask(failing(*[kind()] * n), "x", sleep=waits.append)
    with pytest.raises(M.BadResponse):
        M.ask(failing(*["no json"] * 4), "x", sleep=waits.append)
    with pytest.raises(ZeroDivisionError):
        M.ask(failing(ZeroDivisionError()), "x", sleep=waits.append)


def test_a_client_goes_on_after_a_lost_request():
    client = M.RetryingClient(failing(*["no json"] * 4), sleep=lambda s: None)
    assert client.answer(["x", "y"]) == [None, '{"a": 1}']
